"""Near-duplicates by b-bit MinHash.

Every text's shingle set gets some 200 minima. Bands of five or six of them give candidate keys (32
bands of six at a threshold of 0.85); of the minima themselves only the two low bits are kept, packed
into bit planes. Texts with equal sets are one class, so copies never meet each other. Classes that share a band key form a group under the
key's smallest class. Groups are worked in blocks of bounded size: bit counts of the packed planes
estimate the similarity of a block's classes, corrected for chance agreement of two bits; pairs whose
estimate does not rule them out are confirmed on their full sets; and only a spanning forest of the
confirmed links leaves the block, so a group of m classes gives no more than m links however similar
its members are. A group of several blocks also works its pairs of blocks, unless its classes
are connected already: planes first, then the full sets of those classes that have a likely partner of
another component in the other block. Components of the links end the job. Keys, groups and components
with many members meet their totals by broadcast, so none of them lands in one task.

Two sets at the threshold share no band key with a chance of 3 in 10 million, and the estimate
rules out a linked pair with a chance below one in a billion. Sets are told apart by 128-bit digests,
and shingles by 64-bit numbers: a confirmed link is exact but for clashes of these.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_batches, durable, join_sized, text_of
from .graph import components
from .shingles import Minima, sets_of
from .words import mix, slices

#: Bits kept of a minimum; chance that two sets at the threshold share no band; the estimate's margin in standard errors.
LOW_BITS, MISSED, ERRORS = 2, 3e-7, 6.5
#: A link by default: PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20


@dataclass(frozen=True)
class Shape:
    """What follows from a threshold: ``percent`` of the union that two linked sets share at least."""

    percent: int = PERCENT

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5 if self.percent >= 80 else 4

    @property
    def bands(self) -> int:
        """As few as keep the chance of sharing no band below MISSED, in fours so that planes are whole bytes."""
        needed = math.log(MISSED) / math.log1p(-((self.percent / 100) ** self.rows))
        return 4 * math.ceil(needed / 4)

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        """Estimates below this rule a pair out."""
        agree = 1 - (1 - self.percent / 100) * (1 - 0.5**LOW_BITS)
        return self.percent / 100 - ERRORS * math.sqrt(agree * (1 - agree) / self.minima) / (1 - 0.5**LOW_BITS)


def packed(minima: np.ndarray) -> bytes:
    """The low bits of the minima as bit planes."""
    return b"".join(np.packbits((minima >> np.uint64(k)) & np.uint64(1) == 1).tobytes() for k in range(LOW_BITS))


def estimates(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Similarity of each row of ``left`` to each of ``right`` (packed planes of ``n`` minima as bytes, one row each)."""
    planes = left.reshape(len(left), LOW_BITS, -1), right.reshape(len(right), LOW_BITS, -1)
    differ = np.zeros((len(left), len(right), planes[0].shape[2]), np.uint8)
    for k in range(LOW_BITS):
        differ |= planes[0][:, None, k] ^ planes[1][None, :, k]
    agree = 1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int32) / n
    chance = 0.5**LOW_BITS
    return (agree - chance) / (1 - chance)


def sketches(docs: DataFrame, shape: Shape) -> DataFrame:
    """doc_id, n, digest (of the set), planes, keys of every row; without words the last three are null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(shape.minima)
        bands = mix(np.arange(1, shape.bands + 1, dtype=np.uint64))
        for whole in batches:
            for part in slices(whole, "text"):
                rows = []
                for s in sets_of(part.column("text")):
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    least = minima.of(s)
                    keys = bands.copy()
                    for column in least.reshape(shape.bands, shape.rows).T:
                        keys = mix(keys + column)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), packed(least), keys.view(np.int64)))
                types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n", "digest", "planes", "keys"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n long, digest binary, planes binary, keys array<long>")


def _shared(sets: list[np.ndarray], others: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (indices into the two lists).

    Few pairs are merged one by one. Many are counted by products of 0/1 matrices, over the shingles
    that occur more than once, a few thousand of them at a time.
    """
    if len(pairs) < 4 * (len(sets) + len(others)):
        return np.array([len(np.intersect1d(sets[i], others[j], assume_unique=True)) for i, j in pairs], np.int64)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, others)]
    values = [np.concatenate(x) for x in (sets, others)]
    common = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    total = np.zeros((len(sets), len(others)), np.float32)
    at = [np.searchsorted(common, v) for v in values]
    hit = [(a < len(common)) & (common[np.minimum(a, len(common) - 1)] == v) if len(common) else np.zeros(len(v), bool) for a, v in zip(at, values, strict=True)]
    kept = [(r[h], a[h]) for r, a, h in zip(rows, at, hit, strict=True)]
    order = [np.argsort(a, kind="stable") for _, a in kept]
    kept = [(r[o], a[o]) for (r, a), o in zip(kept, order, strict=True)]
    for lo in range(0, len(common), 4096):
        dense = []
        for (r, a), n in zip(kept, (len(sets), len(others)), strict=True):
            s, e = np.searchsorted(a, [lo, lo + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[r[s:e], a[s:e] - lo] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _likely(planes: np.ndarray, sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of ``lo`` and of ``hi`` that sizes and estimates don't rule out."""
    for at in range(0, len(lo) if len(hi) else 0, 64):
        i = lo[at : at + 64]
        ok = estimates(planes[i], planes[hi], shape.minima) >= shape.floor
        ok &= 100 * np.minimum(sizes[i][:, None], sizes[hi][None]) >= shape.percent * np.maximum(sizes[i][:, None], sizes[hi][None])
        a, b = np.nonzero(ok)
        yield i[a], hi[b]


def links(nodes: np.ndarray, planes: np.ndarray, sets: list[np.ndarray], split: int | None = None, shape: Shape = Shape()) -> list[tuple[int, int]]:  # noqa: B008
    """A spanning forest of the links among a block's classes, as (smallest of the tree, class).

    With ``split``, only links between the first ``split`` classes and the rest are looked for.
    """
    sizes = np.array([len(s) for s in sets])
    lo, hi = (np.arange(len(sets)), np.arange(len(sets))) if split is None else (np.arange(split), np.arange(split, len(sets)))
    found = [np.stack([a[a < b], b[a < b]], axis=1) for a, b in _likely(planes, sizes, lo, hi, shape)]
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return []
    shared = _shared(sets, sets, pairs) if split is None else _shared(sets[:split], sets[split:], pairs - [0, split])
    pairs = pairs[100 * shared >= shape.percent * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - shared)]
    root = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for a, b in nodes[pairs].tolist():
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [(top(x), x) for x in root if top(x) != x]


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in column.to_pylist()])


def _block_links(shape: Shape) -> Callable[[pa.Table], pa.Table]:
    """Links of one block: rows have node, planes, shingles, side (0 or 1; all 0 for a single block)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("side").to_numpy(), kind="stable")))
        side, nodes = table.column("side").to_numpy(), table.column("node").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        split = int((side == 0).sum())
        out = links(nodes, _stacked(table.column("planes")), sets, None if split == len(side) else split, shape)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _likely_classes(shape: Shape) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of two blocks (rows have node, label, planes, n, side), the classes with a likely partner of another label on the other side."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, label, sizes = (table.column(c).to_numpy() for c in ("side", "label", "n"))
        hit = np.zeros(table.num_rows, bool)
        for a, b in _likely(_stacked(table.column("planes")), sizes, np.flatnonzero(side == 0), np.flatnonzero(side == 1), shape):
            other = label[a] != label[b]
            hit[a[other]] = hit[b[other]] = True
        kept = table.filter(pa.array(hit)).select(["node", "side"])
        for name, value in zip(("j", "i", "leader"), reversed(key), strict=True):
            kept = kept.add_column(0, name, pa.array([value.as_py()] * kept.num_rows, pa.int64() if name == "leader" else pa.int32()))
        return kept

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two sets are linked where they share at least ``percent`` of their union. Null and empty texts and
    texts of blanks have no set: they are linked with nothing and kept under their own id. Rows that
    share a doc_id are one document, with the links of all its texts. A null id is no candidate for
    component_id; where a component has no other, component_id is null and its rows are kept. An
    empty table gives an empty result; other columns are not read.
    """
    shape = Shape(percent)
    found = durable(sketches(docs, shape))
    first = F.coalesce("doc_id", F.lit(2**63 - 1))
    grouped = found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("planes", "keys", "n"), first).alias("s"), F.count("*").alias("copies"))
    classes = durable(grouped.select("digest", "least", "copies", F.monotonically_increasing_id().alias("node"), "s.planes", "s.keys", "s.n"))

    # Groups: the classes that share a band key with the key's first class.
    keyed = classes.select("node", F.explode("keys").alias("key"))
    leaders = durable(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n_key")).where("n_key > 1"))
    n_keyed = leaders.agg(F.coalesce(F.sum("n_key"), F.lit(0))).first()[0]
    members = durable(join_sized(keyed, leaders, ["key"], "n_key", n_keyed).where("node <> leader").select("leader", "node").distinct())

    # Their sets, taken anew from the texts of one row of each class.
    wanted = members.select("node").unionByName(members.select(F.col("leader").alias("node"))).distinct()
    chosen = classes.join(wanted, "node", "left_semi").select("digest", "node", "planes", "n", "least")
    sets = durable(_sets(docs, chosen))

    # Blocks of about BLOCK_CLASSES classes and BLOCK_SHINGLES shingles; the group's first class is in each.
    weighed = members.join(sets.select("node", "n"), "node")
    blocks = weighed.groupBy("leader").agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = durable(blocks)
    n_members, most_blocks = blocks.agg(F.coalesce(F.sum("members"), F.lit(0)), F.max("blocks")).first()
    own = join_sized(members, blocks, ["leader"], "members", n_members).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lead = blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("node", F.col("leader"))
    each = own.select("leader", "block", "node").unionByName(lead.select("leader", "block", "node")).join(sets.select("node", "planes", "shingles"), "node")
    edges = durable(each.withColumn("side", F.lit(0)).groupBy("leader", "block").applyInArrow(_block_links(shape), "a long, b long").unionByName(_repeated(found, classes)))
    joined = components(edges)

    if (most_blocks or 0) > 1:
        # Pairs of blocks of the groups that are not yet in one piece.
        joined = durable(joined)
        labelled = own.where("blocks > 1").select("leader", "block", "blocks", "node").join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
        open_groups = labelled.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("leader")
        rest = labelled.join(open_groups, "leader", "left_semi").select("leader", "block", "blocks", "node", "label")
        lower = F.struct(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
        upper = F.struct(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
        planes = rest.join(classes.select("node", "planes", "n"), "node")
        faced = planes.select("leader", "block", "node", "label", "planes", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other <> block")
        faced = faced.select("leader", "node", "label", "planes", "n", F.when(F.col("block") < F.col("other"), lower).otherwise(upper).alias("p")).select("leader", "node", "label", "planes", "n", "p.*")
        likely = faced.groupBy("leader", "i", "j").applyInArrow(_likely_classes(shape), "leader long, i int, j int, node long, side int")
        more = likely.join(sets.select("node", "planes", "shingles"), "node").groupBy("leader", "i", "j").applyInArrow(_block_links(shape), "a long, b long")
        joined = components(edges.unionByName(more))

    # Components are named by their smallest document.
    named = classes.select("digest", "node", "least", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sized = durable(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_classes")))
    n_classes = sized.agg(F.coalesce(F.sum("n_classes"), F.lit(0))).first()[0]
    verdicts = durable(join_sized(named, sized, ["component"], "n_classes", n_classes).select("digest", "component_id", "copies"))
    n_rows = verdicts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    with_set = join_sized(found.where("n > 0").select("digest", "doc_id", "n"), verdicts, ["digest"], "copies", n_rows)
    shown = with_set.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return shown.unionByName(found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _repeated(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of one doc_id's different texts."""
    hashed = F.xxhash64("digest")
    ids = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi")).where("lo < hi").select("doc_id")
    nodes = found.where("n > 0").select("doc_id", "digest").join(ids, "doc_id", "left_semi").distinct().join(classes.select("digest", "node"), "digest")
    first = durable(nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("texts")))
    total = first.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    return join_sized(nodes, first, ["doc_id"], "texts", total).where("a <> node").select("a", F.col("node").alias("b"))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, n, planes, shingles of the chosen classes (digest, node, planes, n, least)."""
    texts = docs.select(F.col("doc_id"), text_of().alias("text"))
    ids = chosen.select(F.col("least").alias("doc_id")).distinct()
    some = texts.join(ids.where("doc_id IS NOT NULL"), "doc_id", "left_semi")
    if chosen.where("least IS NULL").limit(1).count():
        some = some.unionByName(texts.where("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                rows = [s.tobytes() for s in sets_of(part.column("text"))]
                digests = [hashlib.blake2b(r, digest_size=16).digest() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["digest", "shingles"])

    again = some.select("text").mapInArrow(run, "digest binary, shingles binary")
    return again.join(chosen.select("digest", "node", "planes", "n"), "digest").dropDuplicates(["node", "digest"])


#: The links of all pairs that share a shingle, on full sets, and what each document reaches; doc_id is a key.
ORACLE_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM texts)
), hashed AS (SELECT doc_id, md5_number(s) AS s FROM sets
), sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, ' ' ORDER BY s)) AS digest FROM hashed GROUP BY doc_id
), classes AS (SELECT digest, min(doc_id) AS node, any_value(n) AS n FROM sizes GROUP BY digest
), few AS (SELECT node, s, n FROM classes JOIN hashed ON doc_id = node
), pairs AS (
  SELECT a.node AS a, b.node AS b FROM few a JOIN few b ON a.s = b.s AND a.node < b.node AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), near AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (SELECT DISTINCT u, u AS v FROM near UNION SELECT reach.u, near.v FROM reach JOIN near ON near.u = reach.v
), part AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY u
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(p.component, c.node, d.doc_id) AS component_id,
  d.doc_id IS NOT DISTINCT FROM coalesce(p.component, c.node, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN classes c ON c.digest = s.digest LEFT JOIN part p ON p.node = c.node
"""
