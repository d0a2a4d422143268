"""Operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from shiftboard.llm import (
    bloom,
    bpe_fst,
    components,
    decision_list,
    decontaminate,
    license_scan,
    line_dedup,
    near_dup,
    pieces,
    quality_fm,
    range_coder,
    shard_tree,
    token_files,
    url_filter,
    words,
)

from test_text_queries import one_edit, plain_line_dedup

ODD = "doc_id bigint, text string, id int, words int, key int, line int, row int, `odd name` int, n bigint, first int"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, pairs):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, 8) for i, t in pairs], ODD)


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGES = [(None, sentence(1, 30)), (1, None), (2, ""), (3, " \n\t "), (4, sentence(2, 30)), (4, sentence(2, 30)), (5, "x"), (6, sentence(3, 60_000))]


def test_words_are_those_of_the_pattern():
    import regex
    import pyarrow as pa

    texts = ["Ab1 é_Ü-x\x00y", "", None, "\x1c a b　c", "zz " * 5, "漢字 x"]
    for keep, pattern, lower in (("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True), ("graphic", r"[^\x20\x09-\x0D]+", False)):
        for a, b, w in words.split_column(pa.array(texts), keep, lower):
            for i in range(a, b):
                text = texts[i] or ""
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if lower else text
                first, last = w.bounds[i - a], w.bounds[i - a + 1]
                assert [w.text(j, j + 1) for j in range(first, last)] == regex.findall(pattern, text)


def test_components(rows):
    got = components.smallest_reachable(rows([(1, 2), (2, 3), (9, 8), (3, 3), (7, None), (5, 4), (4, 6), (6, 5)], "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (4, 4), (5, 4), (6, 4)}
    path = rows([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in components.smallest_reachable(path).collect()} == {0}
    assert components.smallest_reachable(rows([], "a string, b string")).count() == 0


def test_bloom_loses_nothing(spark):
    from pyspark.sql import functions as F

    d = spark.range(3000).select(F.xxhash64("id").alias("h"))
    f = bloom.build(d, F.col("h"), 3000)
    keys = np.array([r.h for r in d.collect()], np.int64).view(np.uint64)
    assert f.may_have(keys).all()
    assert f.may_have(words.mix(np.arange(100_000, dtype=np.uint64))).mean() < 0.05


def plain_hits(text, items, n=10):
    import regex

    find = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    own, hit, found = find(text or ""), set(), set()
    for item_id, item in items:
        other = find(item or "")
        size = min(n, len(other))
        for s in range(len(other) - size + 1 if other else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == other[s : s + size]:
                    hit |= set(range(p, p + size))
                    found.add(item_id)
    return len(own), len(hit), sorted(map(str, found))


def test_decontamination_equals_brute_force(spark, rows):
    rng = random.Random(4)
    small = WORDS[:3]
    items = [(i, " ".join(rng.choice(small) for _ in range(rng.randrange(0, 16)))) for i in range(12)]
    items += [(50, None), (51, "w0"), (52, sentence(9, 40)), (52, sentence(10, 12)), (53, items[0][1])]
    texts = [(i, " ".join(rng.choice(small) for _ in range(rng.randrange(0, 60)))) for i in range(30)]
    texts += [(100, sentence(9, 40)[:120]), (101, sentence(8, 50) + " " + sentence(9, 40) + " tail"), (102, None), (103, "")]
    got = decontaminate.decontaminate(documents(spark, texts), rows(items, "item_id long, text string")).collect()
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in got} == {i: plain_hits(t, items) for i, t in texts}
    none = decontaminate.decontaminate(documents(spark, EDGES), rows([], "item_id long, text string")).collect()
    assert {r.id for r in none} == {None, 1, 2, 3, 4, 5, 6} and not any(r.contaminated for r in none)
    assert decontaminate.decontaminate(documents(spark, []), rows(items, "item_id long, text string")).count() == 0
    kept = decontaminate.drop_contaminated(documents(spark, texts), rows(items[-3:-2], "item_id long, text string"))
    assert kept.columns == documents(spark, []).columns and {101} & {r.doc_id for r in kept.collect()} == set()


def test_decontamination_of_null_ids(spark, rows):
    items = rows([(7, sentence(9, 40))], "item_id long, text string")
    texts = [(None, "x " + sentence(9, 40)), (None, sentence(11, 30)), (None, None), (1, sentence(9, 40)), (2, sentence(12, 30))]
    got = {r.id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate.decontaminate(documents(spark, texts), items).collect()}
    assert got == {None: (40, 1, ["7"], True), 1: (40, 1, ["7"], True), 2: (0, 0, [], False)}
    kept = decontaminate.drop_contaminated(documents(spark, texts), items)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([texts[1], texts[2], texts[4]], key=repr)


def test_winnowing_always_meets():
    """Every shared run of n words has a window that both texts chose by the same fingerprint."""
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 5, 10).astype(np.uint64)
    for _ in range(50):
        pair = []
        for _ in range(2):
            run = np.concatenate([rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 5, 7).astype(np.uint64)])
            w = words.Words(np.zeros(0, np.uint8), None, None, words.mix(run), np.array([0, len(run)]))
            pair.append({fp for _, _, fps in decontaminate.windows(w, 10, 5, [], False) for fp in fps.tolist()})
        assert pair[0] & pair[1]


def plain_components(texts, size, percent):
    import regex

    sets = {}
    for i, t in texts:
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(len(w) - size + 1, 1))} if w else set()
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i]) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(6), []
    for base in range(6):
        own = [rng.choice(WORDS) for _ in range(rng.choice([6, 30, 80]))]
        for copy in range(7):
            edited = list(own)
            for _ in range(rng.randrange(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            texts.append((100 - base * 7 - copy, " ".join(edited)))
    texts += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "x")]
    got = near_dup.near_duplicates(documents(spark, texts), shingle=4).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == plain_components(texts, 4, 80)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_near_duplicates_in_a_template_family(spark):
    """Many texts of one template that are not similar enough; each bucket's hub is one of them."""
    for seed in range(3):
        rng, texts = random.Random(seed), []
        common = [f"c{seed}_{j}" for j in range(100)]
        for i in range(302):
            own = [f"o{seed}_{i}_{j}" for j in range(14 if i < 300 else 12)]
            texts.append((rng.randrange(1000) * 1000 + i, " ".join(common + own)))
        pair = [i for i, _ in texts[300:]]
        got = {r.id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts), shingle=1).collect()}
        assert got == {i: min(pair) if i in pair else i for i, _ in texts}


def test_near_duplicates_edges(spark):
    got = near_dup.near_duplicates(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.kept for r in got)
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    kept = near_dup.drop_near_duplicates(documents(spark, [(1, sentence(1, 50)), (2, sentence(1, 50)), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == documents(spark, []).columns


def test_near_copies_with_null_or_repeated_ids(spark):
    a, b, c, d = (sentence(i, 60) for i in range(20, 24))
    texts = [(None, a), (None, a), (None, a + " tail"), (5, b), (None, b), (None, "x " + b)]
    texts += [(6, c), (6, c), (6, c.upper()), (6, d), (None, None), (None, ""), (7, ""), (8, sentence(24, 60))]
    got = near_dup.drop_near_duplicates(documents(spark, texts))
    assert got.columns == documents(spark, []).columns
    kept = [(r.doc_id, r.text and r.text.lower()) for r in got.collect()]
    assert sum(i is None and a in (t or "") for i, t in kept) == 1
    rest = [(i, t) for i, t in kept if not (i is None and a in (t or ""))]
    assert sorted(rest, key=repr) == sorted([(5, b), (6, c), (6, d), (None, None), (None, ""), (7, ""), (8, texts[-1][1])], key=repr)


def test_densified_bins_collide_like_the_sets():
    rng = np.random.default_rng(3)
    orders, hits = near_dup.probe_orders(), []
    for _ in range(300):
        common, a, b = (words.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (24, 3, 3))
        x, y = (near_dup.signature(np.unique(np.concatenate([common, z])), orders) for z in (a, b))
        hits.append((x == y).mean())
    assert np.mean(hits) == pytest.approx(24 / 30, abs=0.02)


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    x = rng.random((4, quality_fm.FEATURES), np.float32)
    x[:, 30:] = 0
    m = quality_fm.Machine(0.3, rng.random(quality_fm.FEATURES), rng.random((quality_fm.FEATURES, quality_fm.RANK)), np.zeros(1), np.ones(1))
    pairs = [sum(float(m.factors[i] @ m.factors[j]) * r[i] * r[j] for i in range(30) for j in range(i)) for r in x]
    assert m.logit(x) == pytest.approx(0.3 + x @ m.weight + np.array(pairs), rel=1e-4)


def test_quality_edges(spark, rows):
    junk = [(i, " ".join(f"{w}%%%" for w in sentence(i, 40).split()).upper()) for i in range(300, 340)]
    good = [(i, sentence(i, 40) + ".") for i in range(400, 440)]
    labels = rows([(i, 0) for i, _ in junk] + [(i, 1) for i, _ in good] + [(None, 1), (7, None), (300, 0)], "doc_id long, quality int")
    docs = documents(spark, junk + good + EDGES)
    machine = quality_fm.train(docs, labels, size="n")
    got = quality_fm.score(docs, machine, size="n").collect()
    assert len(got) == len(junk) + len(good) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.id: r.score for r in got}
    assert max(by_id[i] for i, _ in junk) < 0.3 < min(by_id[i] for i, _ in good)
    kept = quality_fm.drop_low_quality(docs, machine, size="n")
    assert kept.schema == docs.schema and not {r.doc_id for r in kept.collect()} & set(range(300, 340))
    empty = quality_fm.train(docs, labels.limit(0))
    assert {r.score for r in quality_fm.score(docs, empty).collect()} == {0.5}
    assert quality_fm.score(documents(spark, []), machine).count() == 0


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(5)
    stats = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    bad = ((stats["a"] > 0.8) & (stats["b"] <= 0.5)) | (stats["c"] > 0.9)
    rules = decision_list.learn(stats, bad, np.arange(900) % 3)
    hit = np.any([decision_list.covered(r, stats, 900) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.95
    assert decision_list.learn(stats, np.zeros(900, bool), np.arange(900) % 3) == []


def test_best_bound_is_the_best_of_all():
    """Every middle between neighbouring values, each way, tried one by one."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 40, 200):
        for values in (rng.random(n), rng.integers(0, 4, n) / 2.0, np.zeros(n)):
            bad = rng.random(n) < 0.4
            bad[0] = True
            p, g = bad.sum(), (~bad).sum()
            tried = []
            distinct = np.unique(values)
            for bound in (distinct[1:] + distinct[:-1]) / 2:
                for above in (True, False):
                    chosen = values > bound if above else values <= bound
                    q, m = (chosen & bad).sum(), (chosen & ~bad).sum()
                    tried.append((q * (np.log2(q / (q + m)) - np.log2(p / (p + g))) if q else -1.0, bound, above))
            got = decision_list._best_bound(values, bad)
            assert got == (max(tried, key=lambda t: t[0]) if tried else (0.0, 0.0, True))


def test_lists_end_by_themselves():
    """More conditions and rules than any small limit would allow."""
    rng = np.random.default_rng(7)
    x = {f"s{i}": rng.random(30_000) for i in range(6)}
    corner = np.all([v > 0.3 for v in x.values()], axis=0)  # six conditions at once
    rules = decision_list.learn(x, corner, np.arange(30_000) % 3)
    assert max(map(len, rules)) >= 6
    stripes = {"a": rng.random(30_000)}
    bad = (stripes["a"] * 40).astype(int) % 2 == 0  # twenty separate bands
    rules = decision_list.learn(stripes, bad, np.arange(30_000) % 3)
    hit = np.any([decision_list.covered(r, stripes, 30_000) for r in rules], axis=0)
    assert len(rules) > 16 and (hit == bad).mean() > 0.97


def test_rules_edges(spark, rows):
    labels = rows([], "doc_id long, quality int")
    got = decision_list.judge(documents(spark, EDGES), labels).collect()
    assert len(got) == len(EDGES)
    assert {(r.id, r.n_words, r.kept) for r in got if r.id in (1, 2, 3, 4)} == {(1, 0, False), (2, 0, False), (3, 0, False), (4, 30, True)}
    assert decision_list.judge(documents(spark, []), labels).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    content = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = bpe_fst.read_ranks(content)
    return content, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_on_odd_texts(vocabulary, monkeypatch):
    content, library = vocabulary
    own, rng = bpe_fst.Tokenizer(bpe_fst.read_ranks(content), public_tokenizers.PATTERN), random.Random(8)
    odd = ["a" * 5000, "ab" * 3000, "  \n\n x  ", "it's we'll", "<|endoftext|>", "é" * 70, "".join(map(chr, range(0x20, 0x3000)))]
    odd += [library.decode([rng.randrange(50_000)]) * rng.randrange(1, 9) + library.decode([rng.randrange(50_000)]) for _ in range(500)]
    for bound in (400_000, 50):  # the second forgets its states all the time
        monkeypatch.setattr(bpe_fst, "MOST_STATES", bound)
        monkeypatch.setattr(bpe_fst, "MOST_PIECES", bound)
        for text in odd:
            assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode_ordinary(text)


def test_pairs_by_halves_are_those_of_merging(vocabulary):
    """Neighbours judged by undoing merges, against merging their bytes; most random pairs stand, so parts of longer tokens are added."""
    machine, rng = bpe_fst.Transducer(bpe_fst.read_ranks(vocabulary[0])), random.Random(3)
    names, pairs = machine.token_bytes, {(rng.randrange(len(machine.ranks)), rng.randrange(len(machine.ranks))) for _ in range(3000)}
    for token in rng.sample(sorted(machine.ranks), 3000) + [b"a" * n for n in range(2, 9)] + [b" " * n for n in range(2, 9)]:
        for cut in range(1, len(token)):
            left, right = machine.merges(token[:cut])[-1], machine.merges(token[cut:])[0]
            pairs |= {(machine.ranks[left], machine.ranks[right]), (machine.ranks[right], machine.ranks[left])}
    got = {p: machine.apart(*p) for p in pairs}
    assert got == {(a, b): machine.merges(names[a] + names[b]) == [names[a], names[b]] for a, b in pairs}
    assert min(sum(got.values()), len(got) - sum(got.values())) > 1000


def test_full_transducer_keeps_states_where_ways_part(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe_fst, "MOST_STATES", 3000)
    machine, rng = bpe_fst.Transducer(bpe_fst.read_ranks(vocabulary[0])), random.Random(5)
    words = ["".join(rng.choices(["ou", "ai", "tre", "elle", "que", "ment", "é", "oi"], k=5)) for _ in range(3000)]
    before = [machine.encode(w.encode()) for w in words]
    assert before == [vocabulary[1].encode_ordinary(w) for w in words] and len(machine.states) <= 3001
    branching = {k for k, x in machine.states.items() if len(x.arcs) > 1}
    machine.forget()
    assert branching and set(machine.states) == branching
    assert all(len(y) < 3 or y[0] in machine.ranks.values() for x in machine.states.values() for y in x.arcs.values())
    assert before == [machine.encode(w.encode()) for w in words]


def test_smaller_memory_gives_the_same_ids(vocabulary):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeéouçn", k=7)) for _ in range(400)) for _ in range(150)]
    own = bpe_fst.Tokenizer(bpe_fst.read_ranks(vocabulary[0]), public_tokenizers.PATTERN, less=100)
    ids = [np.frombuffer(x, "<u4").tolist() for i in range(0, 150, 50) for x in own.ids_of(texts[i : i + 50])]
    assert ids == [vocabulary[1].encode_ordinary(x) for x in texts]
    assert len(own.machine.states) <= bpe_fst.MOST_STATES // 100 + 1 and len(own.machine.pairs) <= bpe_fst.MOST_PAIRS // 100


def test_stream_decoding(vocabulary):
    raw = "aé漢😀x".encode() * 3 + b"\xff\xe2\x82a\xed\xa0\x80\xf4\x90\xf0\x9f"
    for step in (1, 2, 3, 5):
        s = bpe_fst.Utf8Stream()
        assert "".join(s.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + s.close() == raw.decode("utf-8", "replace")


def test_bpe_edges(spark, vocabulary):
    content, library = vocabulary
    encoded = bpe_fst.encode(documents(spark, EDGES), content, public_tokenizers.PATTERN)
    texts = sorted((t or "" for _, t in EDGES))
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()) == sorted(library.encode_ordinary(t) for t in texts)
    assert sorted(r.text for r in bpe_fst.decode(encoded, content, public_tokenizers.PATTERN).collect()) == texts
    assert bpe_fst.round_trip(documents(spark, []), content, public_tokenizers.PATTERN).count() == 0
    digests = {r.decoded_sha256 for r in bpe_fst.round_trip(documents(spark, EDGES), content, public_tokenizers.PATTERN).collect()}
    assert digests == {hashlib.sha256(t.encode()).hexdigest() for t in texts}


def test_range_coder_round_trip_and_damage(monkeypatch):
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 50_257, range_coder.BLOCK + 9)
    assert np.array_equal(range_coder.decode(range_coder.encode(whole)), whole)
    monkeypatch.setattr(range_coder, "BLOCK", 256)  # read from the header when decoding
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for most in (1, 2, 60, 50_257):
            ids = rng.integers(0, most, n)
            assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)
    repeated = np.tile(rng.integers(0, 50_257, 100), 100)
    data = range_coder.encode(repeated)
    assert len(data) < len(repeated)
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.decode(b"x" * 40)


def test_range_coder_beats_zlib():
    """On the ids of given texts, in blocks of the same size and in one piece."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    own = token_files.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read(), public_tokenizers.PATTERN)
    ids = np.frombuffer(b"".join(own.ids([t or "" for t in texts])), "<u4")
    mine = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(mine), ids)
    short = ids.astype("<u2")
    blocks = [zlib.compress(short[i : i + range_coder.BLOCK].tobytes(), 9) for i in range(0, len(short), range_coder.BLOCK)]
    assert len(mine) < 0.95 * len(zlib.compress(short.tobytes(), 9)) and len(mine) < 0.9 * sum(map(len, blocks))


def test_tree_keeps_every_symbol():
    """However long one digit comes, the others keep a share, and bounds stay in order."""
    tree, lane, rng = range_coder.Tree(1), np.array([0]), np.random.default_rng(3)
    for digit in [*[5] * 300, *[0] * 300, *[15] * 300, *rng.integers(0, 16, 2000)]:
        tree.open(lane, 0, np.array([0]))
        row = tree.row[0].copy()
        assert row[0] == 0 and row[16] == range_coder.UNIT and (np.diff(row) >= 1).all()
        assert all(tree.find(np.array([v]))[0] == d for d in range(16) for v in (row[d], row[d + 1] - 1))
        first, size = tree.use(np.array([digit]))
        assert (first[0], size[0]) == (row[digit], row[digit + 1] - row[digit])


def test_range_coder_refuses_ids_it_cannot_hold():
    for bad in (-1, 65_535, 65_536, 100_000):
        with pytest.raises(ValueError, match="ids must be"):
            range_coder.encode(np.array([1, bad, 2]))
    ids = np.array([0, 65_534, 7])
    assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)


def test_counted_symbols_round_trip_and_damage(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(range_coder, "COUNTED_BLOCK", 64)
    for n in (0, 1, 2, 63, 64, 65, 3000):
        for most in (1, 2, 60, 70_000):
            symbols = rng.integers(0, most, n)
            assert np.array_equal(range_coder.decode_counted(range_coder.encode_counted(symbols)), symbols)
    symbols = rng.zipf(1.5, 3000).clip(max=5000)
    monkeypatch.setattr(range_coder, "MOST_COUNTED", 100)  # counts are halved, none to 0
    data = range_coder.encode_counted(symbols)
    monkeypatch.undo()  # the size of a block is read from the header
    assert np.array_equal(range_coder.decode_counted(data), symbols)
    for at in (-40, 30):  # a block, the counts
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode_counted(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.decode_counted(b"x" * 40)


def test_runs_cut_as_the_pattern_does():
    assert pieces.RUNS == public_tokenizers.PATTERN
    runs, plain, rng = pieces.Runs(), pieces.Splitter(pieces.RUNS), random.Random(6)
    parts = ["'", "'s", "'re", "'ll", *"lestmdvx!<1\0\n\t É漢½٣", "  ", "\u3000", "\xa0", "\x1c", "\x85", "\u200b", "\u0301", "\U0001f600"]
    for _ in range(2000):
        texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(rng.randrange(6))]
        distinct, places, at = runs.distinct(texts)
        assert [[distinct[i] for i in places[a:b]] for a, b in zip(at, at[1:])] == [plain.full.findall(x) for x in texts]
        assert len(set(distinct)) == len(distinct)


def test_runs_leave_equal_hashes_to_the_pattern(monkeypatch):
    monkeypatch.setattr(pieces, "hash_spans", lambda codes, starts, ends: (ends - starts).astype(np.uint64))
    assert pieces.Runs().distinct(["ab cd ab"]) is None and pieces.Runs().distinct(["ab", " cd"]) is not None
    own = token_files.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read(), public_tokenizers.PATTERN)
    assert own.ids(["ab cd ef ab"]) == own._library_ids(["ab cd ef ab"])


def test_a_task_writes_several_chunks(spark, tmp_path, monkeypatch):
    content, step = open(public_tokenizers.path("byte_bpe_50k.json")).read(), []
    monkeypatch.setattr(token_files, "map_arrow", lambda d, f, schema, keeps: step.append(f) or d)
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(token_files, "CHUNK_IDS", 60)
    monkeypatch.setattr(token_files, "TEXTS", 4)
    texts = [f"word{i} of {i * i}" for i in range(40)]
    batches = [pa.RecordBatch.from_pydict({"id": [None, *range(1, 20)], "text": texts[:20]}), pa.RecordBatch.from_pydict({"id": range(20, 40), "text": texts[20:]})]
    want = [x + b"\x02\0\0\0" for x in token_files.Encoder(content, None).ids(texts)]
    for label, pattern in (("words", public_tokenizers.PATTERN), ("ids", None)):
        token_files.write(documents(spark, EDGES), str(tmp_path / label), content, pattern=pattern)
        rows = [r for b in step[-1](batches) for r in b.to_pylist()]
        assert len(rows) > 3 and [(r["part"], r["chunk"]) for r in rows] == [(3, i) for i in range(len(rows))]
        found = [token_files.unpack(r["data"]) for r in rows]
        assert [r["n_ids"] for r in rows] == [len(x[2]) for x in found]
        assert [x for f in found for x in f[0].tolist()] == [token_files.NO_ID, *range(1, 40)]
        assert [x for f in found for x in f[1].tolist()] == [len(x) // 4 for x in want]
        assert b"".join(f[2].astype("<u4").tobytes() for f in found) == b"".join(want)


def test_a_worker_forgets_words_between_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORDS", 20)
    content, texts = open(public_tokenizers.path("byte_bpe_50k.json")).read(), [f"word{i} of {i * i}" for i in range(40)]
    own, got = token_files.Encoder(content, public_tokenizers.PATTERN), []
    for i in range(0, 40, 4):
        words = token_files.Words(own, 2)
        assert len(own.vocabulary) < 10
        sizes = words.add(texts[i : i + 4])
        got.append(token_files.unpack(token_files.pack_words(list(range(4)), sizes, words))[2].astype("<u4").tobytes())
    assert b"".join(got) == b"".join(x + b"\x02\0\0\0" for x in own._library_ids(texts))


def test_chunks_code_words_not_ids():
    """Words of texts come back as ids, in less space than ids one by one take; the library's model sees each distinct word once."""
    content = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    texts = [*[t or "" for t in texts], "a<|endoftext|>b", "", "\x00 \x00", "x" * 500, "\U0001f600 漢字  \u3000\n"]
    own = token_files.Encoder(content, public_tokenizers.PATTERN)
    asked, ask = [], own._model_ids
    own._model_ids = lambda pieces: asked.extend(pieces) or ask(pieces)
    words = token_files.Words(own, 2)
    sizes = [n for i in range(0, len(texts), 100) for n in words.add(texts[i : i + 100])]
    data = token_files.pack_words(list(range(len(texts))), sizes, words)
    doc_ids, lengths, ids = token_files.unpack(data)
    want = [x + b"\x02\0\0\0" for x in own._library_ids(texts)]
    assert doc_ids.tolist() == list(range(len(texts))) and lengths.tolist() == sizes == [len(x) // 4 for x in want]
    assert ids.astype("<u4").tobytes() == b"".join(want)
    assert len(asked) == len(set(asked)) and len(data) < len(range_coder.encode(ids))


def test_mixed_symbols_round_trip_and_damage(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(range_coder, "MIXED_BLOCK", 64)
    for n in (0, 1, 2, 63, 64, 65, 3000):
        for most in (1, 2, 60, 70_000, range_coder.MOST_SYMBOLS):
            symbols = rng.integers(0, most, n)
            symbols[n // 2 :] = symbols[: n - n // 2]  # some are guessed
            assert np.array_equal(range_coder.decode_mixed(range_coder.encode_mixed(symbols)), symbols)
    symbols = rng.zipf(1.5, 3000).clip(max=5000)
    data = range_coder.encode_mixed(symbols)
    monkeypatch.undo()  # the size of a block is read from the header
    assert np.array_equal(range_coder.decode_mixed(data), symbols)
    raised, places = 0, rng.integers(struct.calcsize(range_coder.MIXED_HEAD), len(data), 60).tolist()
    for at in places:
        broken = bytearray(data)
        broken[at] ^= 1 << at % 8
        try:
            assert np.array_equal(range_coder.decode_mixed(bytes(broken)), symbols)  # a bit behind a block's last symbol
        except ValueError:
            raised += 1
    assert raised > 50
    with pytest.raises(ValueError):
        range_coder.decode_mixed(b"x" * 40)
    for bad in (-1, range_coder.MOST_SYMBOLS):
        with pytest.raises(ValueError, match="symbols must be"):
            range_coder.encode_mixed(np.array([1, bad, 2]))


def test_mixed_intervals_stay_wide_enough():
    """Whatever comes, an interval can be cut into the parts of the next symbol."""
    rng = np.random.default_rng(6)
    coder = range_coder.LongCoder(2000)
    coder.shift = lambda go, low: None
    for bits in rng.integers(7, 33, 300).tolist():
        size = 1 + (rng.integers(0, 1 << 62, 2000) >> rng.integers(62 - bits, 62, 2000)).clip(max=(1 << bits) - 1)
        size = size.clip(max=(1 << 32) - 1)
        first = rng.integers(0, (1 << bits) - size + 1).clip(max=(1 << 32) - 1)
        before = coder.low.astype(object) + coder.width.astype(object)
        coder.narrow(bits, (first << 32 | size).astype(np.uint64))
        assert (coder.low.astype(object) + coder.width.astype(object) <= before).all() and (coder.width > 0).all()
        coder.renew()
        assert int(coder.width.min()) >= 1 << 32
        assert max(coder.low.astype(object) + coder.width.astype(object)) <= 1 << 64


def test_chunks_learn_what_follows():
    """Words that are equally frequent take little space where the last one or the last two tell the next, and counts follow what comes."""
    content, rng = open(public_tokenizers.path("byte_bpe_50k.json")).read(), random.Random(7)
    letters = "abcdefghijkl"
    names = [f" {a}{b}{c}" for a in letters for b in letters for c in letters][:1500]
    cycle = names * 40
    pairs, x, y = [], 0, 1
    for _ in range(60_000):
        x, y = y, (x * 7 + y * 11 + 3) % 31  # the last word alone does not tell
        pairs.append(names[y])
    shuffled = [w for _ in range(40) for w in rng.sample(names, len(names))]

    def bits(words_of_text):
        own = token_files.Encoder(content, public_tokenizers.PATTERN)
        words = token_files.Words(own, 2)
        sizes = words.add(["".join(words_of_text)])
        data = token_files.pack_words([1], sizes, words)
        ids = token_files.unpack(data)[2]
        assert ids.astype("<u4").tobytes() == own._library_ids(["".join(words_of_text)])[0] + b"\x02\0\0\0"
        return 8 * len(data) / len(words.all())

    assert bits(cycle) < 4 and bits(pairs) < 1.5 and 10 < bits(shuffled) < 14


def test_token_files_edges(spark, tmp_path, monkeypatch):
    content = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    got = {}
    for label, pattern in (("own", public_tokenizers.PATTERN), ("library", None)):
        path = str(tmp_path / label)
        token_files.write(documents(spark, EDGES), path, content, pattern=pattern)
        got[label] = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
        assert sum(len(r.ids) for r in token_files.read_ids(spark, path).collect()) == sum(r.n_tokens for r in got[label])
    assert got["own"] == got["library"]
    assert [r.id for r in got["own"]] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [r.start for r in got["own"]] == [sum(r.n_tokens for r in got["own"][:i]) for i in range(len(EDGES))]
    token_files.write(documents(spark, []), str(tmp_path / "none"), content)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_added_tokens_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "it's we'll 漢字", "<|endoftext|>", " x <|endoftext|>\n<|endoftext|> y", "<|endoftext", ""]
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(want[0]) == 3
    for pattern in (public_tokenizers.PATTERN, None):
        own = token_files.Encoder(open(path).read(), pattern)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == want


def test_shards_follow_weights(spark):
    from pyspark.sql import functions as F

    keys = spark.range(6000).select("id", shard_tree.descend(F.col("id"), shard_tree.tree(24)).alias("a"))
    heavy = shard_tree.descend(F.col("id"), shard_tree.tree(24, {5: 3.0})).alias("b")
    moved = keys.select("*", heavy).collect()
    counts = np.bincount([r.a for r in moved], minlength=24)
    assert counts.min() > 150 and counts.max() < 350
    # shard 5 is in the first region and its second rack: movement stays in subtrees whose weight grew
    assert all(r.a == r.b or (r.b // 8 == 0 and (r.a // 8 != 0 or r.b // 4 == 1)) for r in moved)
    assert sum(r.b == 5 for r in moved) > 2 * counts[5]


def plain_shard(key, node):
    """The draws of each level, one by one."""
    while node.shard is None:
        drawn = {}
        for i, c in enumerate(node.children):
            first = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
            bits = xxhash.xxh64(c.name.encode(), seed=first).intdigest() >> 11
            drawn[i] = np.log((bits + 1) / 2**53) / c.weight
        node = node.children[max(drawn, key=drawn.get)]
    return node.shard


@pytest.mark.parametrize("shards", [1, 5, 20, 23, 24, 25])
def test_one_more_shard_only_takes(spark, shards):
    ids = [None, *range(-3, 600)]
    weights = {0: 2.0, 3: 0.5}
    got = shard_tree.assign(documents(spark, [(i, "x") for i in ids]), shards, weights=weights).collect()
    root = shard_tree.tree(shards, weights)
    assert len(got) == len(ids)
    for r in got:
        assert r.shard == plain_shard(r.id, root)
        assert r.grown_shard == plain_shard(r.id, shard_tree.grown(root, shards))
        assert r.grown_shard in (r.shard, shards)
    assert any(r.grown_shard == shards for r in got)


def test_shard_edges(spark, tmp_path):
    got = shard_tree.assign(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and {r.size for r in got if r.id in (1, 2)} == {8}
    assert len({r.shard for r in got if r.id == 4}) == 1 and len({(r.shard, r.slot) for r in got}) == len(got)
    assert shard_tree.assign(documents(spark, [])).count() == 0
    shard_tree.write_shards(documents(spark, EDGES), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(EDGES)


def test_line_dedup_equals_brute_force(spark):
    rng, pool = random.Random(3), []
    for i in range(12):
        own = sentence(i, rng.choice([2, 5, 9, 40]))
        pool.append(own)
        for _ in range(4):
            at, what = rng.randrange(len(own)), rng.choice(["", "é", "x", "ab"])
            pool.append(own[:at] + what + own[at + rng.randrange(2) :])
    texts = {i: "\n".join(rng.choice(pool + ["", "  "]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(0, 9))) for i in range(40)}
    texts |= {50: None, 51: "", 52: "y" * 5000 + "\n" + "y" * 4999, 53: "y" * 2500 + "z" + "y" * 2499}
    assert one_edit("abc", "abd") and one_edit("abc", "ac") and not one_edit("abc", "abc") and not one_edit("abc", "bd")
    out = line_dedup.dedup_lines(documents(spark, list(texts.items())), size="n")
    want = plain_line_dedup(texts)
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n == (None if r.text is None else len(r.text)) for r in got)
    assert out.columns == documents(spark, []).columns


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(documents(spark, EDGES)).collect()
    assert len(out) == len(EDGES) and {r.text for r in out if r.doc_id == 1} == {None}
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_of_rows_that_share_an_id(spark):
    """A row loses lines of its own only: no line that stands once is lost, and of equal lines one stays."""
    texts = [(7, "one\ntwo\nthree"), (7, "four\none\nfive"), (None, "same line\nalpha only here"), (None, "beta only here\nsame line")]
    texts += [(7, None), (None, ""), (None, "same line\nalpha only here of 20 and more"), (9, "alpha only here of 20 and  more\none\nsix")]
    out = line_dedup.dedup_lines(documents(spark, texts).repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in texts)
    left = [x for r in out for x in (r.text or "").split("\n") if x]
    near = "alpha only here of 20 and  more"
    assert sorted(left) == sorted({x for _, t in texts for x in (t or "").split("\n") if x and x != near})
    # the first of rows that share an id is the one whose text has the smaller hash
    again = line_dedup.dedup_lines(documents(spark, texts[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    # rows equal in id and text are treated alike
    twice = line_dedup.dedup_lines(documents(spark, [(1, "a\na\nb"), (1, "a\na\nb"), (2, "b")])).collect()
    assert sorted((r.doc_id, r.text) for r in twice) == [(1, "a\nb"), (1, "a\nb"), (2, "")]


@pytest.mark.parametrize("least", [1, 5, 17])
def test_line_dedup_of_shorter_lines(spark, least):
    rng = random.Random(least)
    texts = {i: "\n".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 22))) for _ in range(4)) for i in range(40)}
    got = line_dedup.dedup_lines(documents(spark, list(texts.items())), least=least)
    assert {r.doc_id: r.text for r in got.collect()} == plain_line_dedup(texts, least)


def test_license_scan_edges(spark):
    body = "see http://x. permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
    texts = [*EDGES, (20, body), (21, "MIT  License mit-license MIT LICENSE"), (22, "the mit of license"), (23, "license " * 3000), (24, "Licensed under CC BY-NC 4.0.")]
    got = {r.id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got[20].labels == ["mit"] and got[20].base_labels == [] and got[20].score > 0.9
    assert (got[21].n_base, got[21].first_word, got[21].last_word, got[21].base_labels) == (3, 0, 4, ["mit"])
    assert got[22].labels == [] and got[23].labels == [] and got[24].labels == ["cc-by-nc"]
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].score) == (0, 0, None, 0.0)
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_one_word_keys_among_many_licence_words(spark):
    own = [*license_scan.TEMPLATES, license_scan.Template("zlib", "released under zlib terms today", "zlib"), license_scan.Template("wtfpl", "wtfpl", "wtfpl")]
    many = "permission merge sublicense noninfringement tortious merchantability unencumbered affero mozilla creative commons redistribution binary"
    texts = [(1, "released under zlib terms today"), (2, f"released under zlib terms today {many}"), (3, f"{many} x y wtfpl z"), (4, "zlib alone"), (5, "under zlib today")]
    got = {r.id: r.labels for r in license_scan.scan(documents(spark, texts), templates=own).collect()}
    assert got == {1: ["zlib"], 2: ["zlib"], 3: ["wtfpl"], 4: [], 5: []}


def test_whole_notices_are_found(spark):
    texts = [(i, f"/* Copyright (c) 2001\n{t.text.upper()}. some code follows") for i, t in enumerate(license_scan.TEMPLATES) if len(t.words) > 20]
    # a fifth of the words changed, none of them in the key phrase
    rng = random.Random(1)
    for i, t in enumerate(license_scan.TEMPLATES):
        if len(t.words) > 40:
            key = range(t.key_at, t.key_at + len(t.key.split()))
            texts.append((100 + i, " ".join(w if q in key or rng.random() > 0.1 else "other" for q, w in enumerate(t.words))))
    got = {r.id: r.labels for r in license_scan.scan(documents(spark, texts)).collect()}
    assert len(got) > 15 and all(license_scan.TEMPLATES[i % 100].label in found for i, found in got.items())


def test_url_filter(spark, rows):
    rules = [url_filter.Rule("bad.org", "/", "block"), url_filter.Rule("bad.org", "/ok/", "allow")]
    link = '<link href="{}" REL="canonical">'
    pages = [
        (1, "http://BAD.org/x?q#f", None),
        (2, "https://sub.bad.org/ok/y", ""),
        (3, "http://a.net/1", link.format("http://bad.org/z")),  # alias of a blocked URL
        (4, "http://a.net/2", link.format("/1")),  # by way of 3
        (5, "http://a.net/d/3", '<meta http-equiv="refresh" content="0; url=../1">'),  # resolved: an alias of 3
        (6, "http://notbad.org/", link.format("//bad.org/ok/a")),
        (7, "https://bad.org/ok/b", link.format("http://bad.org/z")),  # an allow of its own holds
        (8, None, "<link>"),
        (9, "no scheme", link.format("http://bad.org/z")),
        (10, "http://A.net/2#x", ""),  # the same URL as 4
        (None, "http://bad.org", "<p>"),
        (1, "http://BAD.org/x?q#f", None),
    ]
    d = rows([(*p, 1, 2) for p in pages], "page_id long, url string, html string, key int, host int")
    got = sorted(url_filter.judge(d, rules).collect(), key=lambda r: (r.id is None, r.id or 0))
    assert [r.verdict for r in got] == ["block", "block", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert [r.rule for r in got[:3]] == ["bad.org/", "bad.org/", "bad.org/ok/"] and got[0].host == "bad.org" and got[0].path == "/x"
    table = rows([("http://c.net/q", "http://bad.org/z")], "a string, b string")
    assert url_filter.judge(rows([(1, "https://c.net/q", None)], "page_id long, url string, html string"), rules, redirects=table).first().verdict == "block"
    assert url_filter.judge(rows([], "page_id long, url string, html string"), rules).count() == 0


def test_links_are_resolved_as_browsers_do(spark, rows):
    from pyspark.sql import functions as F
    from urllib.parse import urldefrag, urljoin, urlsplit

    base = "http://a.net/b/c/d.html?q=1"
    links = ["g", "./g", "g/", "/g", "//h.net", "//h.net/x/../y", "?y", "g?y", "", "#s", "g#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g"]
    links += ["../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://x.net/a/../b", "?a=1&amp;b=2", "mailto:x@y.z"]
    for url in (base, "http://a.net", "http://a.net/", "http://a.net/x/y/"):
        d = rows([(x, url) for x in links if x], "link string, url string")
        for r in d.select("link", url_filter.key_of(url_filter.resolved(F.col("link"), F.col("url"))).alias("key")).collect():
            want = urldefrag(urljoin(url, r.link.replace("&amp;", "&")))[0]
            if r.link.startswith("mailto:"):
                assert r.key is None
                continue
            # once more for absolute links, whose dot segments the library leaves
            want = urlsplit(want)
            want = urlsplit(urljoin(f"http://{want.netloc}/", f"{want.path}?{want.query}"))
            assert r.key == f"://{want.netloc}{want.path}" + (f"?{want.query}" if want.query else ""), (url, r.link)


def test_empty_segments_stay(spark):
    from pyspark.sql import functions as F

    d = spark.range(1).select(F.lit("a//b/../c").alias("link"), F.lit("http://X.net/y//z").alias("url"))
    assert d.select(url_filter.key_of(url_filter.resolved(F.col("link"), F.col("url")))).first()[0] == "://x.net/y//a//c"


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    after = corpus_pipeline.run(spark, folder)
    assert 0 < after.count() <= before
    assert after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def write_tables(spark, folder, rows):
    """The pipeline's tables: given rows as documents, labels and benchmark of the smallest scale."""
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, id int, key int, line int, n int, component_id int, `odd name` int"
    data = [(i, t, "en", "src1", None if t is None else len(t), *range(7)) for i, t in rows]
    spark.createDataFrame(data, shape).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_on_edge_rows(spark, tmp_path):
    """Null, shared and repeated ids, null and very long texts, and names that operators use go through every stage."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in given[:120]]
    rows += [(None, r.text) for r in given[120:140]]  # no id
    rows += [(rows[0][0], r.text) for r in given[140:160]]  # one id, many texts
    rows += [rows[3], rows[3], (None, rows[125][1]), (None, None), (None, ""), (10**9, None), (10**9 + 1, sentence(3, 60_000))]
    folder = write_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == columns, name
        # a stage invents no rows, and only the one for lines changes texts
        had, has = (Counter((r.doc_id, None if name == "lines" else r.text) for r in d.collect()) for d in (before, docs))
        assert not has - had, name
        counts.append(docs.count())
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == counts[-1] > 60
    assert Counter(r.decoded_sha256 for r in out) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    # rows without an id, and those that share one, are still there
    assert sum(r.doc_id is None for r in out) > 5 and sum(r.doc_id == rows[0][0] for r in out) > 5


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = write_tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0
