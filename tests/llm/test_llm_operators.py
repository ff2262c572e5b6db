"""Operators on a table of odd cases, against brute force."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelkit.llm import bpe_codec, common, deobfuscate, exact_dedup, graph, language_id, lm_scoring, minhash, packing, quality, queries, sharding, token_counts, tokenizer, toxicity
from parcelkit.llm.common import documents
from parcelkit.llm.words import mix

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def odd_texts():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdeghilmnorst"), rng.integers(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base = prose(150).split()
    near = []
    for k in range(12):  # copies with a few words changed each
        w = list(base)
        for at in rng.choice(150, 1 + k % 3, replace=False):
            w[at] = f"changed{k}"
        near.append(" ".join(w))
    texts = [None, "", " ", "\n\n", "one", "two words", "One", "ONE", "É", "é", "<|endoftext|> x", "漢字 かな", "   x", "x" * 20_000, prose(9000), "ab " * 9000]
    texts += [prose(80), prose(80)] * 2 + near + [near[0].upper(), near[0]] + ["line a b c\nline a b c\nline d\n\nline a b c", "#$% " * 30, "spam " * 40]
    return texts + [prose(int(n)) for n in rng.integers(1, 60, 40)]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    out = [(k * 3 + 1, t, ["en", "de", "fr", None][k % 4], f"src{k % 2}") for k, t in enumerate(texts)]
    return out + [(1000, None, None, None), (1000, None, None, None), (1001, texts[16], "en", "s"), (1001, texts[16], "en", "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3, "doc_id")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("n", "key", "row", "place", "digest", "held_out", "score", "kept", "_row", "_text", "_n_words", "count", "value", "id")])


@pytest.fixture(scope="module")
def labels(spark, rows):
    known = [(r[0], int(k % 5 > 0), int(k % 7 == 0)) for k, r in enumerate(rows)] + [(4, 0, 1), (None, 1, 0), (99_999, 1, 1)]
    return spark.createDataFrame(known, "doc_id long, quality int, toxic int")


def with_null_id(spark, docs):
    return docs.unionByName(docs.where("doc_id = 13").withColumn("doc_id", F.lit(None).cast("long")))


def empty(docs):
    return docs.where("false")


def by_id(df):
    return collections.Counter(map(tuple, df.collect()))


def test_exact_dedup(spark, docs, rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(d)
    expected = collections.Counter()
    for t, ids in groups.items():
        for d in ids:
            expected[d, max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert by_id(exact_dedup.exact_dedup(docs)) == expected
    weak = lambda c: F.length(c).cast("long")  # noqa: E731  identifiers that clash
    assert by_id(exact_dedup.exact_dedup(docs, weak)) == expected
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0
    with_null = exact_dedup.exact_dedup(with_null_id(spark, docs)).where("doc_id IS NULL").first()
    assert with_null["keep_id"] == 22 and not with_null["kept"]


def test_chunks_are_the_text(spark, docs):
    t = docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", exact_dedup.chunks_of(F.col("t")).alias("c"))
    assert t.where(F.concat_ws("", "c") != F.col("t")).count() == 0
    assert t.agg(F.max(F.size("c"))).first()[0] > 10
    assert t.where(F.exists("c", lambda c: F.length(c) > exact_dedup.MOST)).count() == 0


def test_token_counts(spark, docs, rows):
    library = tokenizer.library(tokenizer.vocabulary("word_bpe_49k.json"))
    expected = collections.Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 2048) for d, t, *_ in rows)
    assert by_id(token_counts.token_counts(docs)) == expected
    assert token_counts.token_counts(empty(docs)).count() == 0


def test_codec(spark, docs, rows):
    library = tokenizer.library(tokenizer.vocabulary("byte_bpe_50k.json"))
    expected = collections.Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert by_id(bpe_codec.codec_digests(docs)) == expected
    assert by_id(bpe_codec.codec_digests(docs, leaf=64)) == expected
    assert bpe_codec.codec_digests(empty(docs)).count() == 0


def test_lm_scores(spark, docs, rows):
    counts = collections.Counter()
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 10:
            counts.update([*words_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.lm_scores(docs).collect()
    assert len(got) == len(rows) and not any(math.isnan(r["score"]) or r["score"] > 0 for r in got)
    expected = {}
    for d, t, *_ in rows:
        w = [*words_of(t), "\n"]
        expected[d] = (len(w), sum(x in counts for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    for r in got:
        assert (r["n_tokens"], r["n_known"]) == expected[r["doc_id"]][:2] and r["train_tokens"] == n
        assert math.isclose(r["base_score"], expected[r["doc_id"]][2], rel_tol=1e-9) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    assert lm_scoring.lm_scores(empty(docs)).count() == 0
    alone = lm_scoring.lm_scores(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)).collect()
    assert alone and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0) for r in alone)


def test_lm_words_beyond_the_held_counts(spark, docs, monkeypatch):
    whole = {(r["doc_id"], r["n_known"]): (r["base_score"], r["score"]) for r in lm_scoring.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_scoring, "HELD", lm_scoring.Units.words_for(lm_scoring.LEAST_SIDE) + 20)
    for r in lm_scoring.lm_scores(docs).collect():
        assert (r["base_score"], r["score"]) == pytest.approx(whole[r["doc_id"], r["n_known"]], rel=1e-3)


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    one, many = ({tuple(r)[:5]: r["score"] for r in lm_scoring.lm_scores(docs.repartition(n)).collect()} for n in (2, 16))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-6) for k in one)


def test_lm_counts_beyond_what_a_task_keeps(spark, docs, monkeypatch):
    whole = sorted(map(tuple, lm_scoring.lm_scores(docs).drop("score").collect()), key=repr)
    monkeypatch.setattr(lm_scoring, "COUNTED", 50)
    assert sorted(map(tuple, lm_scoring.lm_scores(docs).drop("score").collect()), key=repr) == whole


def test_lm_prefers_text_to_shuffled_and_random_words(spark, sf_dir):
    table = documents(spark, str(Path(sf_dir).parent / "sf0.01")).where("length(text) > 400").select("doc_id", "text")
    held = [r for r in table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()]
    rng = np.random.default_rng(3)
    pool, other = [w for r in held for w in r["text"].split()], []
    for k, r in enumerate(held):
        w = r["text"].split()
        other.append((10 * k, -1, " ".join(rng.permutation(w))))
        other.append((10 * k + 1, -2, " ".join(rng.choice(pool, len(w)))))  # other languages' and topics' words among them
        other.append((10 * k + 2, -3, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in w)))
    ids = [i for i in range(10**6, 11 * 10**5) if zlib.crc32(str(i).encode()) % 10 == 0][: len(other)]
    made = {i: (held[o[0] // 10]["doc_id"], o[1]) for i, o in zip(ids, other, strict=True)}
    more = spark.createDataFrame([(i, o[2]) for i, o in zip(ids, other, strict=True)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.lm_scores(table.unionByName(more)).collect()}
    better = collections.defaultdict(list)
    for i, (d, kind) in made.items():
        better[kind].append(got[d] - got[i])
    assert np.mean(better[-1]) > 0 and np.mean(better[-2]) > 0.1 and min(better[-3]) > 0, {k: (np.mean(v), np.mean(np.array(v) > 0)) for k, v in better.items()}
    scores = lm_scoring.lm_scores(table).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scores[0] > scores[1]


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdeghilmnorst"), rng.integers(2, 7))) for _ in range(200)]
    rows, known = [], []
    for k in range(600):
        w = list(rng.choice(vocabulary, 30))
        if k % 5 == 0:
            w[3] = "idiot" if k % 2 else "scumbag"
        rows.append((k, " ".join(w)))
        known.append((k, int(k % 5 == 0)))
    extra = [(10_001, " ".join(vocabulary[:20]) + " 1d10t"), (10_002, "i d i o t " + " ".join(vocabulary[:20])), (10_003, None), (10_004, ""), (10_005, " ".join(vocabulary[:20])), (10_005, " ".join(vocabulary[:20]))]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    said = {r["doc_id"]: r["predicted"] for r in got}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(said[k] == int(k % 5 == 0) for k in held) / len(held) > 0.97
    assert (said[10_001], said[10_002], said[10_003], said[10_004], said[10_005]) == (1, 1, 0, 0, 0)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if not r["predicted"])
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(empty(docs), labels).count() == 0


def test_odd_rows_have_a_toxicity(docs, labels, rows):
    assert toxicity.toxicity(docs, labels).count() == len(rows)


def test_language_id(spark, sf_dir, docs, rows):
    got = {r["doc_id"]: r for r in language_id.language_id(documents(spark, sf_dir)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents(spark, sf_dir).collect()}
    held = [d for d in got if got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.9
    odd = language_id.language_id(docs).collect()
    text = {d: t for d, t, *_ in rows}
    assert len(odd) == len(rows)
    for r in odd:
        has_letter = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not has_letter) and 0 <= r["score"] <= 1
    assert language_id.language_id(empty(docs)).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("n_shards", [8, 3])
def test_sharding(spark, docs, rows, n_shards):
    got = sharding.shard(docs, n_shards).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {d: (t or "").encode() for d, t, *_ in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    assert by_id(sharding.shard(docs, n_shards)) == by_id(sharding.shard(docs.repartition(7), n_shards))
    assert sharding.shard(empty(docs)).count() == 0 and sharding.shard(with_null_id(spark, docs)).count() == len(rows) + 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1023])
def test_permutations_walk_back(spark, n):
    got = sharding.permuted(spark.range(n), "id", n, "p").collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    if n > 50:
        assert sum(r["p"] == r["id"] for r in got) < 10


def linked(rows, percent=85):
    sets = {}
    for d, t, *_ in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_near_duplicates(spark, docs, rows, monkeypatch):
    expected = linked(rows)
    assert sum(not kept for *_, kept in expected.values()) > 8
    check = lambda df: {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()} == expected and df.count() == len(rows)
    assert check(minhash.near_duplicates(docs))
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 3)  # groups of several blocks
    assert check(minhash.near_duplicates(docs))
    assert minhash.near_duplicates(empty(docs)).count() == 0
    nulls = minhash.near_duplicates(with_null_id(spark, docs)).where("doc_id IS NULL").first()
    assert (nulls["component_id"], nulls["kept"]) == (13, False)


def test_near_duplicates_with_an_estimate_that_never_rules_out(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "ERRORS", 1000.0)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {d: c for d, (_, c, _) in linked(rows).items()}


def test_near_duplicates_at_another_threshold(spark, docs, rows):
    expected = linked(rows, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 80).collect()} == expected


def test_large_keys_meet_by_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(common, "LARGE_ROWS", 1)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {d: c for d, (_, c, _) in linked(rows).items()}
    sizes = collections.Counter((t or "").translate(FOLD) for _, t, *_ in rows)
    text = {d: (t or "").translate(FOLD) for d, t, *_ in rows}
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and all(r["group_size"] == sizes[text[r["doc_id"]]] for r in got)
    clashing = exact_dedup.exact_dedup(docs, digest=lambda c: F.struct(F.size(c).alias("a")))
    assert by_id(clashing) == by_id(exact_dedup.exact_dedup(docs))


def test_an_id_with_two_texts_is_one_document(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[::-1])), (5, " ".join(words) + " x"), (5, " ".join(words[::-1]) + " x"), (7, " ".join(words[30:] + words[:30][::-1]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (5, 1), (5, 1), (7, 7)]


def test_near_copies_found_on_the_documents(spark, sf_dir):
    """Queries: every row whose id is divisible by 50, against all rows."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, str(Path(sf_dir).parent / "sf0.01")).collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for d, t in rows for w in [words_of(t)]}
    component = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, str(Path(sf_dir).parent / "sf0.01"))).collect()}
    found = []
    for d in (d for d, _ in rows if d % 50 == 0 and sets[d]):
        for other, s in sets.items():
            k = len(sets[d] & s)
            if other != d and s and 100 * k >= 85 * (len(sets[d]) + len(s) - k):
                found.append(component[d] == component[other])
    assert found and np.mean(found) >= 0.9


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, docs, rows):
    library = tokenizer.library(tokenizer.vocabulary("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t, *_ in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert sum(r["length"] for r in got) == sum(len(ids[d]) for d, *_ in rows)
    for d, mine in pieces.items():
        assert all(r["ids_crc32"] == zlib.crc32(ids[d][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[d]) for r in mine)
    for mine in sequences.values():
        mine.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist()
        n = sum(r["length"] for r in mine)
        assert n <= 1024 and n & (n - 1) == 0
    assert packing.pack(empty(docs)).count() == 0


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, labels):
    got = quality.quality(docs, labels).collect()
    text = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        m = measures(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert all(r["kept"] != r["base_failed"] for r in quality.quality(docs, labels.where("false")).collect())
    assert quality.quality(empty(docs), labels).count() == 0


def test_cutoffs_hold_on_good_documents(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"{' '.join(f'w{x}' for x in rng.integers(0, 9999, 40))}{' #' * (12 if k % 4 == 0 else 0)}", "en", int(k % 4 != 0)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int")
    got = quality.quality(docs, docs.selectExpr("doc_id", "q AS quality")).join(docs.select("doc_id", "q"), "doc_id").groupBy("q").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r["q"]: r["k"] for r in got}
    assert rate[1] >= 1 - quality.RATE and rate[0] == 0


def test_a_language_without_cutoffs_does_not_take_the_shared_ones(spark):
    rng = np.random.default_rng(6)
    words = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9999, 40))
    rows = [(k, words(), None, 1) for k in range(4000)] + [(4000 + k, words() + " #" * 12, "xx", 1) for k in range(20)] + [(5000, words() + " #" * 12, "yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int")
    labels = docs.where("q = 1").selectExpr("doc_id", "q AS quality")
    chosen = quality.cutoffs(quality._narrow(quality.measured(docs)), labels)
    assert chosen["xx"] == {} and chosen[""]["symbol_rate"] < 0.05
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs, labels).collect()}
    assert all(kept[k] for k in range(4000, 4020)) and not kept[5000]
    assert quality.keep_good(docs, labels).where("lang = 'xx'").count() == 20


def test_verdicts_are_those_of_cutoffs_tested_one_by_one(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 9999, n)]
    rows = []
    for k in range(4200):
        w = words(40)
        if k % 40 == 0:
            w = w + ["#"] * int(rng.integers(1, 30))
        if k % 30 == 0:
            w = w[:8] * int(rng.integers(1, 2)) + w
        if k % 50 == 0:
            w = [w[0]] * int(rng.integers(1, 9)) + w
        text = "\n".join([" ".join(w)] * (2 if k % 70 == 0 else 1))
        rows.append((k, text, ["en", None, "de"][0 if k < 3900 else 1 if k < 4000 else 2], int(k % 9 != 0 and k % 40 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int")
    got = {r["doc_id"]: r for r in quality.quality(docs, docs.selectExpr("doc_id", "q AS quality")).collect()}

    def rates(text):
        n_words, chars, symbols, dup, repeat = measures(text)
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = max(1, n_words)
        return {"symbol_rate": symbols / max(1, chars), "stutter_rate": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "dup_line_rate": dup / max(1, len(lines)), "repeat_rate": repeat / n, "mean_word": chars / n}

    found = {d: rates(t) for d, t, *_ in rows}
    failed = {d: got[d]["base_failed"] for d in got}
    good = {lang: [d for d, _, x, q in rows if q and x == lang and not failed[d]] for lang in ("en", "de", None)}
    tests, chosen = 3 * len(quality.RULES), {}
    for lang, ids in good.items():
        for rule, cuts in quality.RULES.items():
            for c in cuts:
                k, n, p = sum(found[d][rule] > c for d in ids), len(ids), quality.RATE / len(quality.RULES)
                if not (k < n * p and sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) <= quality.LEVEL / tests):
                    break
                chosen[lang, rule] = c
    assert any(lang == "en" for lang, _ in chosen) and not any(lang != "en" for lang, _ in chosen)
    for d, _, lang, _ in rows:
        assert got[d]["kept"] == (not failed[d] and all(found[d][rule] <= chosen.get((lang, rule), math.inf) for rule in quality.RULES)), d
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values())


def test_binomial_tails(spark):
    cases = [(0, 10), (3, 50), (40, 1000), (0, 1), (30, 1000)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.05))
    for r in df.collect():
        exact = sum(math.comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < 0.05 * r["n"] else 1.0
        assert r["p"] == pytest.approx(exact, rel=1e-9)


def test_pipeline(spark, sf_dir, tmp_path):
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == documents(spark, sf_dir).columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0 and (before is None or k == 4 or docs.count() <= before)
        before = docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == before


def test_stages_take_odd_rows_and_empty_tables(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() > 0
        assert stage(spark, empty(docs), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df, found = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    place = [found.columns.index(c) for c in columns]
    expected = collections.Counter(tuple(r[k] for k in place) for r in found.fetchall())
    assert expected and by_id(df.select(columns)) == expected


@pytest.mark.parametrize("run, columns", [
    (lambda d, _: token_counts.token_counts(d), ["n_bytes", "n_tokens", "over_limit"]),
    (lambda d, _: bpe_codec.codec_digests(d, leaf=2), ["n_tokens", "ids_sha256", "decoded_sha256"]),
    (lambda d, _: lm_scoring.lm_scores(d), ["n_tokens"]),
    (lambda d, labels: toxicity.toxicity(d, labels), ["score", "predicted"]),
    (lambda d, _: language_id.language_id(d), ["lang_pred", "score"]),
    (lambda d, _: packing.pack(d), ["doc_tokens"]),
    (lambda d, labels: quality.quality(d, labels), ["n_words", "word_chars", "base_failed", "kept"]),
])
def test_a_null_id_is_a_document(spark, docs, labels, rows, run, columns):
    got = run(with_null_id(spark, docs), labels).where("doc_id IS NULL OR doc_id = 13").collect()
    assert {r["doc_id"] for r in got} == {None, 13}
    null, same = ({tuple(r[c] for c in columns) for r in got if (r["doc_id"] is None) == own} for own in (True, False))
    assert null == same


def test_stages_take_a_null_id(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, with_null_id(spark, docs), sf_dir).count() > 0, name


def test_languages_are_those_of_plain_counting(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    for d, text in docs.select("doc_id", "text").collect()[:60]:
        raw = [(b + 32 if 65 <= b <= 90 else b) if letter(b) else 32 for b in (text or "").encode()]
        counts, padded = np.zeros(language_id.DIMENSIONS, np.float32), [32, *raw, 32, 32]
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            for code in ([a << 16 | b << 8 | c] if b != 32 else []) + ([0x9000000 | b << 8 | c] if b != 32 or c != 32 else []):
                counts[(code * 2654435761 % 2**32 >> 15) % language_id.DIMENSIONS] += 1
        names, chance = model.predict(language_id.scaled(counts[None]))
        if any(c.isalpha() for c in text or ""):
            assert got[d]["lang_pred"] == names[0] and got[d]["score"] == pytest.approx(chance[0], abs=1e-4)


def test_toxicity_is_that_of_plain_counting(spark, sf_dir):
    folder = str(Path(sf_dir).parent / "sf0.01")
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    channel, buckets, weights = toxicity.learn(docs, labels)
    decoder, place = deobfuscate.Channel(channel), {b: k for k, b in enumerate(buckets.tolist())}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    letter = re.compile(rb"[0-9a-z\x80-\xff]")
    for d, text in docs.select("doc_id", "text").collect()[:80]:
        text, shown = text or "", pa.array([text or ""])
        if deobfuscate.suspicious(shown)[0] or deobfuscate.ends_open(shown)[0]:
            text = f"{text} \n {deobfuscate.restored(text, decoder)}"
        folded = [c if letter.match(bytes([c])) else 32 for c in bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())]
        drawn = [32] + [c for k, c in enumerate([*folded, 32]) if k == 0 or c != folded[k - 1] or c >= 128]
        present = np.zeros(len(buckets))
        for k in range(len(drawn) - 4):
            packed = sum(c << 8 * (4 - i) for i, c in enumerate(drawn[k : k + 5]))
            bucket = int(mix(np.array([packed], np.uint64))[0] % np.uint64(toxicity.BUCKETS))
            if bucket in place:
                present[place[bucket]] = 1
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(present @ weights[:-1] + weights[-1]))), abs=1e-4), d


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))
