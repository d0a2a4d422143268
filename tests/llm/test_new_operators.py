"""Centroid clustering, the divergence audit and piece encoding on small fixtures, against plain versions."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece

from shiftboard.llm import centroids, divergence, piece_bpe

from test_text_operators import EDGES, ODD, documents

NAN, INF = math.nan, math.inf
VECTORS = "vec_id bigint, embedding array<double>, v int, id int, cluster int, `odd name` int"


def plain_clusters(rows, k, rounds, size):
    """The rounds as they are told, over plain integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(kept, best) if c == j]
            if mine:
                at[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    best = assign()
    total, each = sum(d for d, _ in best), Counter()
    for d, c in best:
        each[c] += d
    return Counter((i, c, d, each[c], total, at[c]) for (i, _), (d, c) in zip(kept, best))


def clusters(spark, rows, **options):
    d = spark.createDataFrame([(i, e, 1, 2, 3, 4) for i, e in rows], VECTORS)
    found = centroids.cluster(d.repartition(3), **options)
    return Counter((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(i % 3, 0.7), 2) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)]  # one vector, many times
    rows += [(3, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0, 1.0]), (300, None), (301, []), (302, [1.0]), (303, [1.0, None, 1.0, 1.0])]
    rows += [(304, [1.0, NAN, 1.0, 1.0]), (305, [1.0, INF, 1.0, 1.0]), (306, [1.0] * 5), (307, [-0.0001] * 4)]
    for rounds in (0, 4):
        assert clusters(spark, rows, k=5, rounds=rounds, size=4) == plain_clusters(rows, 5, rounds, 4)


def test_cluster_edges(spark):
    assert clusters(spark, [], size=4) == Counter()
    assert clusters(spark, [(None, [1.0] * 4)], size=4) == Counter()  # no vector to start from
    two = [(1, [1.0] * 4), (2, [1.0] * 4)]
    # equal first centroids: the smaller number takes all, the other stays empty
    assert clusters(spark, two, size=4) == Counter({(1, 0, 0, 0, 0, (1024,) * 4): 1, (2, 0, 0, 0, 0, (1024,) * 4): 1})
    with pytest.raises(Exception, match="must stay below"):
        clusters(spark, [(1, [1e300] * 4)], size=4)


TERM = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, most):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(held):
            total = sum(held[t] for t in kept)
            return {t: 1 + 10**9 * (held[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item, -value, n) for n, (value, _, item) in enumerate(ranked, 1)}
    return out


def audited(spark, rows, **options):
    shape = "text string, lang string, source string, term int, n int, value int, doc_id int"
    d = spark.createDataFrame([(*r, 1, 2, 3, None) for r in rows], shape)
    return [tuple(r) for r in divergence.audit(d.repartition(5), **options).collect()]


@pytest.mark.parametrize("cells", [divergence.CELLS, 20])
def test_audit_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "BLOCK", 2)
    rng = random.Random(7)
    words = ["Ab", "aB", "ab", "é", "É", "x1y", "ﬁ", "漢", "zz", "Ünter", "don't", "\U0001f600", "q"]
    rows = [(" ".join(rng.choice(words[: 5 + i % 9]) for _ in range(rng.randint(0, 12))), rng.choice("abc"), rng.choice(["s", "t", "é", None, "\U0001f600", "ｚ"])) for i in range(300)]
    rows += [("word " * 60_000, "a", "s"), (None, "a", "silent"), ("", None, None), ("once only", "lone", "one"), ("x", "pair", "one"), ("y", "pair", "two")]
    rows += [("same text", "a", "s")] * 20
    got = audited(spark, rows, least=4, most=3, cells=cells)
    want = plain_audit(rows, 4, 3)
    assert set(got) == want and len(got) == len(want)


def test_audit_edges(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []
    # no kept terms: pairs are 0
    assert sorted(audited(spark, [("a b", "l", "x"), ("c", "l", "y")])) == [("l", "x", "pair", "y", 0, 1), ("l", "y", "pair", "x", 0, 1)]


def test_audit_shares_are_exact():
    count = np.array([0, 1, 7, 10**12, 10**15], np.int64)
    for total, terms in ((10**15, 10**6), (2 * 10**15, 3), (10**15 + 7, 1)):
        got = divergence.share(count, total, terms).tolist()
        assert got == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in count]


def test_partial_counts_are_added_up(monkeypatch):
    """However small the steps of a task, its partial rows add up to the same counts."""
    rows = [(f"l{i % 2}", f"s{i % 3}", " ".join(f"wö{c}" * (1 + j % 4) for j, c in enumerate("abcdef"[i % 5 :]))) for i in range(200)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])

    def counts():
        out = Counter()
        for b in divergence.partial_counts(iter([batch.slice(0, 50), batch.slice(50, 150)])):
            b.validate(full=True)
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    want = counts()
    monkeypatch.setattr(divergence, "SLICE", 64)
    monkeypatch.setattr(divergence, "PENDING", 4)
    assert counts() == want


@pytest.fixture(scope="module")
def pieces():
    content = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    return content, piece_bpe.Model(content), sentencepiece.SentencePieceProcessor(model_proto=content)


def coded(model, texts):
    out = []
    for a, b, ids, bounds in piece_bpe._encoded(pa.array(texts, pa.string()), model, True):
        decoded = piece_bpe.decode_flat(ids, bounds, model)
        out += [(ids[x:y].tolist(), t.decode()) for x, y, t in zip(bounds, bounds[1:], decoded)]
    return out


def test_pieces_on_odd_texts(pieces, monkeypatch):
    _, model, library = pieces
    rng = random.Random(5)
    parts = [" ", "  ", "▁", "a", "th", "the", "é", "中", "文", "\U0001f600", "\n", "\x00", "<s>", "</s>", "<0x0A>", "aaaa", "0", "12", "́", "ß", "я", "при", "的", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)), "x" * 5000, None, "", " ", " " * 99]
    monkeypatch.setattr(piece_bpe, "SLICE", 1000)
    for text, (ids, decoded) in zip(texts, coded(model, texts), strict=True):
        want = library.encode(text or "", add_eos=True)
        assert ids == want, text
        assert decoded == library.decode(want), text


def test_decoding_any_ids(pieces):
    _, model, library = pieces
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randint(0, rng.choice([5, 300, model.size - 1])) for _ in range(rng.randint(0, 12))]
        assert piece_bpe.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]), model)[0].decode() == library.decode(ids), ids
    with pytest.raises(ValueError):
        piece_bpe.decode_flat(np.array([model.size]), np.array([0, 1]), model)


def plain_merges(symbols, rank):
    """One merge at a time: lowest rank first, leftmost of those."""
    symbols = list(symbols)
    while True:
        found = [(rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [rank[symbols[i], symbols[i + 1]][1]]


def test_rounds_where_merges_bring_forth_better_ones():
    """Ranks that no training would give: a merge may make a pair that comes before it."""
    rng = random.Random(8)
    for _ in range(300):
        pairs, n = {}, 3
        for _ in range(rng.randint(1, 8)):
            pair = rng.randrange(n), rng.randrange(n)
            if pair not in pairs:
                pairs[pair] = n
                n += 1
        rank = {p: (rng.randrange(6), m) for p, m in pairs.items()}
        columns = np.array([(a, b, r, m) for (a, b), (r, m) in rank.items()], np.int64).T
        table = piece_bpe.PairTable(*columns, n)
        words = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
        flat, bounds = np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])])
        out, ends = piece_bpe.merge_rounds(flat, bounds, table)
        assert [out[a:b].tolist() for a, b in itertools.pairwise(ends)] == [plain_merges(w, rank) for w in words]


def test_piece_edges(spark, pieces):
    content, _, library = pieces
    d = documents(spark, EDGES)
    rows = piece_bpe.encode(d, content).collect()
    assert sorted((str(r.id), r.n_tokens) for r in rows) == sorted((str(i), len(library.encode(t or "", add_eos=True))) for i, t in EDGES)
    back = piece_bpe.decode(piece_bpe.encode(d, content), content)
    assert Counter((r.id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in EDGES)
    assert piece_bpe.encode(d, content, end=False).filter("n_tokens = 0").count() == 2
    assert piece_bpe.round_trip(spark.createDataFrame([], ODD), content).count() == 0
