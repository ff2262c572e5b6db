"""Tokenizers, words, curves and models, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from parcelkit.llm import bpe_codec, deobfuscate, language_id, minhash, neural, packing, shingles, svm, token_counts, tokenizer, words

ALPHABETS = ["abcdefghij", "aaaaab", "0123 ", " \n\t", "'s're'll", "ß é ü漢字かな", "!!??--", "the quick brown fox jumps. "]


def random_text(rng, special=()):
    parts = []
    for _ in range(rng.randint(1, 8)):
        a = rng.choice(ALPHABETS)
        parts.append("".join(rng.choice(a) for _ in range(rng.choice([1, 5, 40, 120]))))
        if special and rng.random() < 0.1:
            parts.append(rng.choice(special))
    return "".join(parts)


def fold(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))


@pytest.fixture(scope="module")
def codec():
    return tokenizer.byte_codec(tokenizer.vocabulary("byte_bpe_50k.json"))


def test_every_token_encodes_as_the_library_has_it(codec):
    library = tokenizer.library(codec.path)
    texts = []
    for t in codec.tokens:
        try:
            texts.append(t.decode())
        except UnicodeDecodeError:
            continue
    assert all(e.ids == codec.encode(t).tolist() for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))


def test_joined_pieces_are_the_whole_text(codec):
    rng, library = random.Random(3), tokenizer.library(codec.path)
    special = list(codec.special)
    texts = [random_text(rng, special) for _ in range(200)]
    texts += ["x" * 5000, "ab" * 3000, "é" * 2500, "漢" * 2500, " " * 4000, "!?" * 2500, "1234567890" * 400, "a" * 3000 + "'s" + "b" * 3000, "", " ", special[0] * 3]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(4000)), "".join(rng.choice(" \n\t") for _ in range(3000))]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        for leaf in (7, 64, 700):
            parts = bpe_codec.pieces_of(text, special, leaf)
            assert "".join(p for _, p in parts) == text and all(len(p) <= leaf or p in special for _, p in parts)
            assert bpe_codec.join_all(codec, [(h, codec.encode(p)) for h, p in parts]).tolist() == ids
        assert codec.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False) == text


def test_windows_of_tokens_inside_long_runs(codec):
    rng = random.Random(8)
    for alphabet in ("abcdefghijklmnop", "aab", "0123456789", "-=!?"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        left, right = codec.encode(text[:1500]), codec.encode(text[1500:])
        assert bpe_codec._by_tokens(codec, left, right).tolist() == codec.encode(text).tolist()


def test_counts_are_the_library_s():
    path = tokenizer.vocabulary("word_bpe_49k.json")
    rng, library, lengths = random.Random(5), tokenizer.library(path), token_counts.Lengths(path, remembered=60)
    texts = [random_text(rng, ["<|endoftext|>", "<|startoftext|> ", "İı x", "é ́a "]) for _ in range(400)] + ["", "Word, WORD. word!", "x " * 100_000]
    assert lengths.count(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_numbered_by_their_folded_bytes():
    texts = ["Hello World foo", "", None, "foo  bar\nHELLO", "x" * 70_000 + " a", "é È foo", " \t\x0b\x0c\r\n"]
    numbers, at = words.of_column(pa.array(texts))
    expected = [words_of(t) for t in texts]
    assert np.diff(at).tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    seen = dict(zip(flat, numbers.tolist(), strict=True))
    assert all(seen[w] == n for w, n in zip(flat, numbers.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    assert np.diff(words.of_column(pa.array(texts).slice(1, 3))[1]).tolist() == [0, 0, 3]


def test_words_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(words, "_BLOCK", 16)
    text = "ab " + "y" * 10_000 + " cd ef " + "z" * 40
    numbers, _ = words.of_column(pa.array([text]))
    monkeypatch.undo()
    assert numbers.tolist() == words.of_column(pa.array([text]))[0].tolist()


def test_shingle_sets():
    a, b, c, d = shingles.sets_of(pa.array(["a b c d e f", "a b c d e f a b c d e f", "a b", ""]))
    assert len(a) == 2 and len(b) == 6 and len(c) == 1 and len(d) == 0 and set(a) <= set(b)


def test_estimates_follow_the_similarity():
    rng, minima = np.random.default_rng(1), shingles.Minima(192)
    for share in (0.5, 0.85, 1.0):
        got = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
            same = int(1000 * share)
            x, y = pool[:1000], np.r_[pool[:same], pool[1000 : 2000 - same]]
            planes = [np.frombuffer(minhash.packed(minima.of(s)), np.uint8)[None] for s in (x, y)]
            got.append(minhash.estimates(*planes, 192)[0, 0])
        assert abs(np.mean(got) - share / (2 - share)) < 0.03


def test_links_by_merging_and_by_products_agree():
    rng, minima = np.random.default_rng(2), shingles.Minima(192)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        at = rng.choice(300, rng.integers(5, 30), replace=False)
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.int64).astype(np.uint64)
        sets.append(np.unique(s))
    pairs = np.array([(i, j) for i in range(80) for j in range(i)])
    assert minhash._shared(sets, sets, pairs).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    planes = np.stack([np.frombuffer(minhash.packed(minima.of(s)), np.uint8) for s in sets])
    root = list(range(80))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs.tolist():
        k = len(np.intersect1d(sets[i], sets[j]))
        if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    forest = minhash.links(np.arange(80), planes, sets)
    assert sorted(forest) == sorted((top(x), x) for x in range(80) if top(x) != x)


def test_hilbert_steps_to_neighbours():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    place = packing.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_ranges_have_like_weights():
    weights = np.array([0, 5, 5, 0, 100, 3, 9, 2, 0])
    first, parts, n = packing.ranges(weights, 10)
    assert parts.tolist() == [1, 1, 1, 1, 10, 1, 1, 1, 1] and first[[1, 2, 4, 5, 6, 7]].tolist() == [0, 0, 1, 11, 12, 13] and n == 14
    assert packing.ranges(np.zeros(4, int), 10)[2] == 1


def test_packer_leaves_no_padding():
    packer, rng = packing.Packer(0), np.random.default_rng(4)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 1500, 1024, 3, 700, 1)]
    rows = [r for k, d in enumerate(docs) for r in packer.add(k, d)] + packer.close()
    for k, d in enumerate(docs):
        mine = sorted(r for r in rows if r[0] == k)
        assert [r[1] for r in mine] == np.cumsum([0, *(r[2] for r in mine)])[:-1].tolist() and sum(r[2] for r in mine) == len(d)
    sizes = {}
    for r in rows:
        assert r[6] == sizes.get(r[5], 0)
        sizes[r[5]] = r[6] + r[2]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes.values())


def test_the_network_learns_and_is_normalised():
    rng = np.random.default_rng(6)
    n = 64
    seq = np.zeros(20_000, np.int64)
    for t in range(1, len(seq)):
        seq[t] = (seq[t - 1] * 3 + 1) % n if rng.random() < 0.8 else rng.integers(n)
    start, share = np.zeros(len(seq), np.int64), (np.bincount(seq, minlength=n) + 1) / (len(seq) + n)
    model = neural.LogBilinear.new(share)
    before = model.log10(seq, start).mean()
    assert abs(before - np.log10(share[seq]).mean()) < 0.02
    trainer = neural.Trainer(model, share, rate=0.3)
    for _ in range(20):
        trainer.train(seq, start)
    assert model.log10(seq, start).mean() > before + 0.2
    context = seq[:50]
    total = sum(10 ** model.log10(np.r_[context, k], np.zeros(51, np.int64))[-1] for k in range(n))
    assert abs(total - 1) < 1e-4
    assert np.array_equal(neural.LogBilinear.of_flat(model.flat(), 8).mixing, model.mixing)


def test_spans_look_back(monkeypatch):
    rng = np.random.default_rng(7)
    seq, share = rng.integers(0, 64, 3000), np.full(64, 1 / 64)
    start = (np.arange(3000) // 700) * 700
    model = neural.LogBilinear.new(share)
    whole = model.log10(seq, start)
    monkeypatch.setattr(neural, "SPAN", 100)
    monkeypatch.setattr(neural, "SCORED", 250)
    assert np.allclose(model.log10(seq, start), whole, atol=1e-5)


def test_numbers_are_found():
    rng = np.random.default_rng(9)
    known = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    found = words.Numbering(known)
    assert found.find(known).tolist() == list(range(len(known)))
    others = rng.integers(-(2**63), 2**63 - 1, 5000)
    assert (found.find(others) == np.where(np.isin(others, known), np.searchsorted(known, others), -1)).all()
    assert words.Numbering(np.zeros(0, np.int64)).find(np.array([0, 5])).tolist() == [-1, -1]
    assert words.Numbering(np.array([0, 1])).find(np.array([1, 0, 2])).tolist() == [1, 0, -1]


def test_linear_models_separate():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] > 0, 1, -1).astype(np.float32)
    w = svm.linear_svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97
    w = svm.logistic(x, (y > 0).astype(np.float32), 1e-3)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_one_language_and_one_family_are_enough():
    x = np.eye(4, 8, dtype=np.float32)
    names, chance = language_id.Hierarchy(x, np.array(["en"] * 4)).predict(x)
    assert names == ["en"] * 4 and (chance == 1).all()
    names, _ = language_id.Hierarchy(x, np.array(["en", "en", "xx", "xx"])).predict(x)
    assert names == ["en", "en", "xx", "xx"]


def test_disguised_words_are_restored():
    text = ["the stupid idiot is a loser and a moron with the trash that stinks, he is pathetic"] * 50
    channel = deobfuscate.Channel(deobfuscate.trigrams(pa.array(text)))
    got = deobfuscate.restored("you 1d10t and st00pid, stuuuupid l0ser! a s t u p i d one", channel).split()
    assert {"idiot", "stupid", "loser"} <= set(got)
    flags = deobfuscate.suspicious(pa.array(["plain words. and more!!", "1d10t", "sooo", "s t u p i d", "a.b", None, ""]).fill_null(""))
    assert flags.tolist() == [False, True, True, True, False, False, False]


def test_long_spaced_runs_and_long_words_are_restored_to_their_end(monkeypatch):
    text = ["the stupid idiot is a loser and a moron with the trash that stinks, he is pathetic"] * 50
    channel = deobfuscate.Channel(deobfuscate.trigrams(pa.array(text)))
    run = " ".join("theisandwith" * 20 + "1d10t")
    assert deobfuscate.restored(run, channel).replace(" ", "") == "theisandwith" * 20 + "idiot"
    assert deobfuscate.restored("x" * 100 + "1d10t", channel).endswith("idiot")
    assert deobfuscate.restored("theisandwith" * 20 + "1d10t", channel) == "theisandwith" * 20 + "idiot"
    words = ["1d10t" * 60, "st00piiid" * 40, "6" * 3 + "1l" * 300 + "d10t"]
    monkeypatch.setattr(deobfuscate, "PIECE", 10**9)
    whole = [channel._decode(w) for w in words]
    monkeypatch.setattr(deobfuscate, "PIECE", 128)
    assert [channel._decode(w) for w in words] == whole


def test_look_alikes_on_either_side_of_a_letter_are_restored():
    text = ["the stupid idiot is a loser and a moron with the trash that stinks, he is pathetic, hi and stop"] * 50
    channel = deobfuscate.Channel(deobfuscate.trigrams(pa.array(text)))
    cases = {"idi07": "idiot", "idio+": "idiot", "idi0+!": "idiot", "tra$#": "tras", "h!": "hi", "stop!": "stop", "i d ! o t": "idiot", "h - 1": None, "a-s-$": "as", "moro7+": "morot"}
    for word, meant in cases.items():
        got = deobfuscate.restored(f"so {word}, they said", channel).split()
        assert meant is None and not got or meant in got, (word, got)
    seen = lambda t: (deobfuscate.suspicious(pa.array([t])) | deobfuscate.ends_open(pa.array([t]))).tolist() == [True]
    assert all(seen(t) for t in ["idi07", "a$$", "h!", "é5", "тупооой", "éÉé", "т у п о й", "й!", "i d ! o t", "漢字漢漢漢"])
    assert not any(seen(t) for t in ["plain words.", "élan", "a.b", "1 2", "漢字", "𐍈 x", ""])
    assert deobfuscate.restored("тупооой", channel) in ("тупой", "тупоой") and deobfuscate.restored("т у п о й", channel) == "тупой"
    wide = pa.array(["élan", "漢字 1d10t", "x", "тупооой", "plain", "naz!"])
    assert deobfuscate.suspicious(wide).tolist() == [False, True, False, True, False, False]
    assert deobfuscate.ends_open(wide).tolist() == [False] * 5 + [True]


def test_gaps_are_part_of_the_lattice():
    text = ["you the stupid idiot is a loser and a moron with the trash that stinks, you are pathetic, hi and stop you"] * 50
    channel = deobfuscate.Channel(deobfuscate.trigrams(pa.array(text)))
    for shown, meant in {"y o u i d i o t": "you idiot", "y o u  i d i o t": "you idiot", "st.up.id": "stupid", "stu-pid": "stupid", "id_1ot": "idiot", "t-h-e-l-0-s-e-r": "the loser", "st*up*1d": "stupid"}.items():
        assert meant in deobfuscate.restored(f"so {shown}, they said", channel), (shown, deobfuscate.restored(f"so {shown}, they said", channel))
        assert deobfuscate.suspicious(pa.array([f"so {shown}, they said", "plain"])).tolist() == [True, False], shown
    assert deobfuscate.suspicious(pa.array(["pathetic-stinking", "a.", "-a-", "x pathetic.is", ""])).tolist() == [False] * 5
