"""Whitening, cross-tokenizer alignment and packing against brute force on small tables and through the registered queries."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import CLASHING, awkward, frame

from cytomill.llm import align, bpe, packing, queries, whitening

TEXTS = [
    "The cat sat on the mat. It's 12 o'clock!", "the cat  sat\n\n on\tthe mat ", "  leading and trailing  ", "naïve café Ünï 日本語 テキスト", "<|endoftext|> inside <0x41> text",
    "▁ a mark of its own", "x" * 500, "a\x00b \x01 \x1c c", "no-break space İstanbul ΣΑΣ", "é combined", "\n", " ", "🎉🎉 party", "the cat sat on the mat",
]
SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ whitening


def _expected(vectors):
    """Whitening by eigh of the exact covariance."""
    kept = [v for v in vectors if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in kept], np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    e, vecs = np.linalg.eigh(c.T @ c / n)
    return kept, x, n, s, e[::-1], vecs[:, ::-1]


def _check_whitening(rows, vectors, same_signs=True):
    kept, x, n, s, e, vecs = _expected(vectors)
    k = min(16, int((e > e[0] * 1e-12).sum()))
    assert len(rows) == k * len(kept)
    assert {r["n"] for r in rows} == {n} and {r["component"] for r in rows} == set(range(1, k + 1))
    want = Counter(int(sum(int(n * a - b) ** 2 for a, b in zip(v.tolist(), s.tolist(), strict=True))) for v in x)
    assert Counter(r["deviation"] for r in rows if r["component"] == 1) == want
    for j in range(k):
        got = np.sort([r["whitened"] for r in rows if r["component"] == j + 1])
        one = np.sort(((n * x - s) / n) @ vecs[:, j] / math.sqrt(e[j]))
        assert min(np.abs(got - one).max(), np.abs(got + one[::-1]).max()) < 1e-6
        assert next(r["explained"] for r in rows if r["component"] == j + 1) == pytest.approx(e[j] / e.sum(), rel=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 20)) * np.geomspace(3, 0.05, 20)
    base[:, 7] = 0.25  # a constant dimension has no component
    vectors = base.tolist() + base[:40].tolist() * 5 + [None, [], [float("nan")] * 20, [float("inf")] + [0.0] * 19, [None] + [0.0] * 19]
    rows = [(i if i % 50 else None, v, *["x"] * len(CLASHING)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, " + ", ".join(f"{c} string" for c in CLASHING if c not in ("key", "n")) + ", key string")
    grid = df.withColumn("x", whitening.on_grid(F.col("v")))
    _check_whitening(whitening.transform(grid, whitening.fit(grid)).collect(), vectors)


def test_whitening_of_few_rows_has_few_components(spark):
    vectors = [[1.0, 2.0, 3.0, 4.0], [2.0, 0.0, 1.0, 4.5], [0.0, 0.5, 9.0, -4.0]]
    grid = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, v array<float>").withColumn("x", whitening.on_grid(F.col("v")))
    _check_whitening(whitening.transform(grid, whitening.fit(grid)).collect(), vectors)


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 9])
def test_whitening_without_variance_gives_no_rows(spark, vectors):
    grid = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, v array<double>").withColumn("x", whitening.on_grid(F.col("v")))
    assert whitening.transform(grid, whitening.fit(grid)).collect() == []


def test_whitening_query(spark):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()]
    _check_whitening(queries.queries()["op11_whitening"](spark, SF).collect(), vectors)


# ------------------------------------------------------------------ tokenizers


def test_rank_tables_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = align.read_tokenizers(queries.BYTE_FILE, queries.PIECE_MODEL)
    words = bpe.ranks_of_merges(queries.WORD_FILE, "</w>")
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789'.,-_#$%&àéèöüßñçÀÉ²½µª\t\n ¡»×÷ĀęįĮ")
    fuzz = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(5000)] + TEXTS
    a, w = Tokenizer.from_str(t.a_file), Tokenizer.from_file(queries.WORD_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=t.b_model)
    a_of, b_of, w_of = t.a_ranks.encoder(), t.b_ranks.encoder(), words.encoder()
    for s in fuzz:
        if bpe.PLAIN.fullmatch(s):
            assert t.a_ranks.ids[a_of(" " + s)].tolist() == a.encode(" " + s).ids
        if bpe.plain_of_pieces(s, t.b_missing):
            assert t.b_ranks.ids[b_of(" " + s)].tolist() == b.encode(s)
        if bpe.PLAIN.fullmatch(s) and "<|" not in s and (found := bpe.WORD_PIECES.findall(s.lower())):
            found = [p for p in found if not p.isspace()]
            assert words.ids[w_of(bpe.END.join(found) + bpe.END)].tolist() == w.encode(s).ids if found else w.encode(s).ids == []


def _brute_alignment(rows):
    """Whole texts by the libraries, groups and links from sets of offsets, counts in one dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    letters = bpe.byte_letters()
    count, found = Counter(), []
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        place_b = {e: j for j, e in enumerate(ends_b)}
        links = [(i, place_b[e]) for i, e in enumerate(ends_a) if e in place_b]
        count.update((ids_a[i], ids_b[j]) for i, j in links)
        found.append((ids_a, ids_b, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, links = f
        p = q = 0
        groups = []
        for i, j in links:
            groups.append(",".join(map(str, ids_a[p : i + 1])) + "|" + ",".join(map(str, ids_b[q : j + 1])))
            p, q = i + 1, j + 1
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        out.append((
            doc, len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == top[x[1]] for x in pairs), sum(count[x] for x in pairs),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return Counter(out)


@pytest.mark.parametrize("most_shared", [align.MOST_SHARED, 0])
def test_alignment_equals_brute_force(spark, most_shared):
    rows = awkward(TEXTS)
    t = align.read_tokenizers(queries.BYTE_FILE, queries.PIECE_MODEL)
    got = align.align(spark, frame(spark, rows).repartition(3), t, most_shared=most_shared)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == _brute_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    t = align.read_tokenizers(queries.BYTE_FILE, queries.PIECE_MODEL)
    assert align.align(spark, frame(spark, []), t).collect() == []
    assert align.align(spark, frame(spark, [(1, None), (None, "")]), t).count() == 2


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_tokenizer_alignment"](spark, SF)
    assert Counter(tuple(r) for r in got.collect()) == _brute_alignment(rows)


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 36, 50_000))
    levels, by_slot = align.build_hash(keys)
    h = align.PerfectHash(align._levels(align._packed_levels(levels)), by_slot)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert (h.slots(keys + (1 << 40)) == -1).all()
    assert align.PerfectHash([], keys[:0].astype(np.uint64)).slots(keys[:5]).tolist() == [-1] * 5


def test_counts_are_summed_over_shards_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(p), int(n)) for p, n in zip(rng.zipf(1.3, 6000) % 900, rng.integers(1, 9, 6000), strict=True)]
    want = Counter()
    for p, n in rows:
        want[p] += n
    table = align.hashed_counts(spark.createDataFrame(rows, "pair long, n long").repartition(3), shard_size=100, fan=2)
    assert {r["pair"]: r["n"] for r in align.listed(table).collect()} == want
    assert align.highest(table) == {b: max(n for p, n in want.items() if p % align.B_IDS == b) for b in {p % align.B_IDS for p in want}}


# ------------------------------------------------------------------ packing


def _check_packing(got, rows, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_FILE)
    want = Counter()
    for doc, text in rows:
        want[doc, tuple([*t.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), Counter())[r["start"], r["length"], r["ids_crc32"]] += 1
    expected = {}
    for (doc, ids), times in want.items():
        pieces = expected.setdefault((doc, len(ids)), Counter())
        for at in range(0, len(ids), capacity):
            own = ids[at : at + capacity]
            pieces[at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += times
    assert by_doc == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = []
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        fills.append(at)
    return fills


def test_packing_holds_each_id_once(spark):
    rows = awkward(TEXTS)
    got = packing.pack_documents(spark, frame(spark, rows).repartition(3), queries.WORD_FILE)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    _check_packing(got.collect(), rows)
    assert packing.pack_documents(spark, frame(spark, []), queries.WORD_FILE).collect() == []


def test_packing_query_pads_little(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fills = _check_packing(queries.queries()["op13_packing"](spark, sf).collect(), rows)
    assert sum(fills) / (4096 * len(fills)) > 0.97


def test_differencing_gives_near_equal_windows():
    lengths = np.random.default_rng(4).integers(1, 400, 900)
    window, sums = packing.difference(lengths, 40)
    assert np.bincount(window, lengths, 40).astype(int).tolist() == sums.tolist()
    assert sums.max() - sums.min() <= 8
    window, sums = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]  # the classic case of the method, one off the best split
    assert packing.difference(np.array([5, 9]), 4)[1].max() == 9


def test_window_count_rises_until_all_fit():
    lengths = np.full(7, 2100)
    window = packing.near_equal(lengths, 4096)
    assert np.bincount(window, lengths).max() <= 4096 and window.max() + 1 == 7
