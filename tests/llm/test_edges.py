"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from verdictframe.llm import kdtree, langid, licenses, linededup, packing, pieces, pii, pq, queries, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, _n_lines string, spans string, score string"
LONG = "word " * 40_000


def frame(spark, rows):
    full = [(*r, *([None] * (3 - len(r))), "s", None, "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, "The shared line is here\nown line of one", "en"),
    (2, "  the SHARED line is here \nown", "en"),
    (2, "  the SHARED line is here \nown", "en"),
    (None, "the shared line is here\nnameless line here", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, LONG, None),
    (6, "!!! 123", "en"),
]


def test_lines(spark):
    got = {(r.doc_id, r.text): r for r in linededup.dedup_lines(frame(spark, ODD), batches=3).collect()}
    assert got[(1, "The shared line is here\nown line of one")]._n_dropped == 0
    assert got[(2, "own")]._n_lines == 2 and got[(2, "own")]._n_dropped == 1
    assert got[(None, "nameless line here")]._n_dropped == 1
    assert got[(3, "")]._n_lines == 1 and got[(4, "")]._n_dropped == 0 and (5, LONG) in got
    assert linededup.dedup_lines(frame(spark, ODD)).count() == len(ODD)


def test_line_runs_do_not_depend_on_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = ({(r.doc_id, r.text) for r in linededup.dedup_lines(docs, batches=b, fanout=f).collect()} for b, f in ((1, 2), (5, 3)))
    assert one == many


def test_hot_lines_change_the_plan_only(spark, monkeypatch):
    rows = [(i, f"line that a third shares\nown line number {i}\npair line number {i // 2}", "en") if i % 3 == 0 else (i, f"pair line number {i // 2}\nown line number {i}", "en") for i in range(300)]
    docs = frame(spark, rows).repartition(7)
    hashes = linededup.line_hashes(docs.selectExpr("doc_id AS doc", "xxhash64(text) AS rk", "text"))
    counts = {bytes(r.h): r["count"] for r in hashes.groupBy("h").count().collect()}
    assert [counts[bytes(r.h)] for r in linededup.hot_hashes(hashes, share=0.1).collect()] == [100]
    got = []
    for share in (0.1, 0.002, 2.0):  # the shared line, all repeated lines, none
        monkeypatch.setattr(linededup.hot_hashes, "__defaults__", (linededup.HOT_SAMPLE, share))
        got.append({(r.doc_id, r.text, r._n_dropped) for r in linededup.dedup_lines(docs).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 300
    assert sum(n for *_, n in got[0]) == 99 + 150


def test_groups(spark):
    got = simhash.simhash_groups(frame(spark, ODD)).collect()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert len(got) == len(ODD) and all(len(v) == 1 for v in by.values())
    assert by["0" * 16] == {3}
    kept = simhash.keep_one(frame(spark, ODD))
    assert kept.columns == [f.split(" ")[0] for f in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 6]


def test_keep_one_goes_by_row(spark):
    words = lambda a: " ".join(f"w{a * 1000 + i}" for i in range(60))
    rows = [(1, words(1)), (1, words(2)), (2, words(3)), (3, words(3)), (3, words(4)), (3, words(4)), (None, words(5)), (None, words(5)), (None, words(5).upper()), (None, words(4)), (4, words(6)), (4, words(6).upper())]
    got = sorted(((r.doc_id, r.text.lower()) for r in simhash.keep_one(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, words(1)), (1, words(2)), (2, words(3)), (3, words(4)), (None, words(5)), (4, words(6))], key=str)
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_language(spark):
    docs = frame(spark, [*ODD, *[(100 + i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en") for i in range(20)]])
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[6].lang_pred == "und" and rows[6].score == 0
    assert rows[101].lang_pred == "de" and rows[102].lang_pred == "en"
    assert langid.identify(frame(spark, ODD), langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert {r.doc_id for r in langid.accepted(docs, model).collect()} == {1, 2, None, 5, *range(100, 120)}


def test_packing(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    got = packing.packed_documents(frame(spark, ODD), path, block=8).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert len(got[got.doc_id == 2]) == 2 and got[got.doc_id == 3].length.tolist() == [1]
    long = got[got.doc_id == 5].sort_values("piece")
    assert (long.length[:-1] == 2048).all() and long.length.sum() == 40_001
    assert all(len(i) == 4 * n for i, n in zip(got.ids, got.length))
    assert got.ids_crc32.equals(got.ids.map(__import__("zlib").crc32))
    many = spark.range(3000).select(F.lit(7).alias("row"), F.col("id").cast("int").alias("piece"), (F.col("id") % 1500 + 1).alias("length"))
    placed = packing.pack(many, block=256).join(many, ["row", "piece"]).toPandas()
    assert len(placed) == 3000 and (placed.groupby("sequence_id").length.sum() <= 2048).all()
    assert placed.sequence_id.nunique() <= -(-placed.length.sum() // 2048) + 3


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x" * 50_000, "1" * 50_000, "1 2 " * 5_000, "+1" * 5_000, "+1 (2) 3-4-5 6 7 8 9 0 x 4111 1111-1111 1111", "256.1.1.1 007.1.2.255", "é𝄞 a@b.co 𝄞", "x a@" + "b." * 20_000 + "c. q@w.e"])
def test_pii_spans(spark, text):
    from tests.llm.test_contract import KINDS, plain_pii

    got = pii.personal_data(frame(spark, [(1, text)])).select(pii.spans_text(F.col("base"))).first()[0]
    assert got == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in plain_pii(text))


def test_pii_learns_contexts(spark):
    rows = [(i, f"please call home on +1 (555) 100-{1000 + i} today", "en") for i in range(12)]
    rows += [(50, "please call home on (555) 777-8888 now", "en"), (51, "version number 20240101 is out", "en"), (None, None, None), (52, "", "en"), (50, "please call home on (555) 777-8888 now", "en")]
    docs = frame(spark, rows)
    got = {r.doc_id: r.shown for r in pii.personal_data(docs).select("doc_id", pii.spans_text(F.col("spans")).alias("shown")).collect()}
    assert got[51] == "" and got[52] == ""
    # the token after the learned context has too few digits to be a number on its own
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[3] == "please call home on [PHONE] today" and masked[None] is None and masked[51] == rows[13][1]
    rows = [(i, f"please call home on +1-555-100-{1000 + i} today", "en") for i in range(12)] + [(50, "please call home on 555-777-8888 now", "en")]
    found = {r.doc_id: r.text for r in pii.mask(frame(spark, rows)).collect()}
    assert found[50] == "please call home on [PHONE] now"


def test_pii_learns_spaced_numbers(spark):
    rows = [(i, f"please call home on +1 (555) 100-{1000 + i} today", "en") for i in range(12)]
    rows += [(100 + i, f"charge my card {4111_1111_1111_0000 + i} now", "en") for i in range(3)]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "3000 0000 0000 04"]
    rows += [(200 + i, f"bill the card {c} now", "en") for i, c in enumerate(cards)]
    rows += [(50, "please call home on (555) 777-8888 now", "en"), (51, "please call home on 555 777 9999, or", "en"), (52, "bill the card 1234 5678 9012 3456 now", "en")]
    rows += [(53, "please call home on 555 777 6666 10.1.2.3 x", "en"), (54, "number of rooms 12 345 6789 found", "en"), (55, "x" * 90 + " on +1 (555) 200-3000", "en"), (None, "please call home on (555) 777-8888 now", "en")]
    docs = frame(spark, rows)
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[50] == masked[None] == "please call home on [PHONE] now" and masked[51] == "please call home on [PHONE], or"
    assert masked[52] == "bill the card [CARD] now" and masked[54] == rows[-3][1]
    assert masked[53] == "please call home on [PHONE] [IP] x"
    shown = {r.doc_id: r.shown for r in pii.personal_data(docs).select("doc_id", pii.spans_text(F.col("spans")).alias("shown")).collect()}
    assert shown[50] == "phone:20:34" and shown[52] == "card:14:33"


def test_pii_contexts_are_whole_words(spark):
    before = ["a b ", "x" * 90 + " on ", "x" * 30_000 + "  " + "y" * 2_000 + "\t", "one\n" + "x" * 90 + " ", "on ", "", "é " * 60 + "Last, words " + " " * 100]
    rows = spark.createDataFrame([(i, t + "1234", len(t)) for i, t in enumerate(before)], "i int, text string, at int")
    got = [r[0] for r in rows.orderBy("i").select(pii._context(F.col("text"), F.col("at"))).collect()]
    assert got == ["a b", "x" * 90 + " on", "x" * 30_000 + "  " + "y" * 2_000, "", "", "", "last words"]


def test_license_templates(spark):
    rows = [(i, f"plain text number {i} the of and to software", "en") for i in range(30)]
    rows += [(100 + i, f"// head\n{text}\n tail", "en") for i, text in enumerate(licenses.TEMPLATES.values())]
    rows += [(200, "permission to use the software is granted", "en"), (201, "MIT licence, mit  LICENSE. Apache-license general public license", "en"), (None, None), (5, "")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in got[100 + i].labels.split(",") and got[100 + i].score > 0.59
    assert all(got[i].labels == "" and got[i].score == 0 for i in (*range(30), 200))
    assert got[201].base_labels == "apache,gpl,mit" and [b.start for b in got[201].base] == [2, 4, 6]
    assert got[None].n_words == 0


def test_licenses_of_repeated_rows(spark):
    rows = [(i, f"plain text number {i} the of and to software", "en") for i in range(30)]
    bsd, mpl = licenses.TEMPLATES["bsd"], licenses.TEMPLATES["mpl"]
    once = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, [*rows, (100, bsd), (None, mpl)])).collect()}
    again = [(r.doc_id, r.labels, r.score > 0.59) for r in licenses.scan(frame(spark, [*rows, (100, bsd), (100, bsd), (None, mpl), (None, mpl), (None, mpl)])).collect() if r.doc_id in (100, None)]
    assert once[100][0] == "bsd" and once[None][0] == "mpl"
    assert sorted(again, key=str) == sorted([(100, "bsd", True)] * 2 + [(None, "mpl", True)] * 3, key=str)


def test_licenses_of_full_files(spark):
    every = sorted(w for w in licenses.POSTINGS)
    # words that only the BSD text has are rarer in the corpus than any other
    common = " x ".join(w for w in every if {label for label, *_ in licenses.POSTINGS[w]} != {"bsd"})
    rows = [(i, common, "en") for i in range(30)]
    rows += [(100, "\n\n".join(licenses.TEMPLATES.values()), "en")]
    # very long texts with the whole vocabulary in loose words, and one template each
    rows += [(200 + i, " x ".join(every) + " word" * 40_000 + f" {text} " + " y ".join(reversed(every)), "en") for i, text in enumerate(licenses.TEMPLATES.values())]
    rows += [(300, " x ".join(every) + " word" * 40_000, "en")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[100].labels == ",".join(sorted(licenses.TEMPLATES)) and got[100].score == 1
    for i, label in enumerate(licenses.TEMPLATES):
        assert set(got[200 + i].labels.split(",")) == {label, *filter(None, got[200 + i].base_labels.split(","))} and got[200 + i].score > 0.999
    assert got[300].labels == "" and got[300].score == 0


def test_sentencepiece_spans(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  a  b ", "tab\there\n\nx", "é𝄞 ▁mark ▁▁", "ﬁ x　y", "a" * 3000, "x  y   z"]
    own = pieces.load(path)
    for text, (ids, starts, ends) in zip(texts, own.encode(texts)):
        check_spans(model, text, ids, starts, ends)
    rows = {r.doc_id: r for r in pieces.encoded(frame(spark, [(i, t) for i, t in enumerate([*texts, None])]), path).collect()}
    assert rows[len(texts)].ids == [] and rows[2].ids == model.encode(texts[2]) and rows[3].decoded == texts[3]


def check_spans(model, text, ids, starts, ends):
    proto = model.encode(text, out_type="proto")
    assert ids.tolist() == [p.id for p in proto.pieces]
    assert [(int(s), int(e)) for s, e in zip(starts, ends)] == [(p.begin, p.end) for p in proto.pieces], text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
def test_character_map(rule):
    """The same normalisation as the library's for its compiled maps, and spans that cover what changed."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    maker = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    made = proto.ModelProto()
    made.ParseFromString(maker.serialized_model_proto())
    base = proto.ModelProto()
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        base.ParseFromString(f.read())
    for trim in (False, True):
        base.normalizer_spec.CopyFrom(made.normalizer_spec)
        base.normalizer_spec.add_dummy_prefix = base.normalizer_spec.escape_whitespaces = True
        base.normalizer_spec.remove_extra_whitespaces = trim
        raw = base.SerializeToString()
        own, model = pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        for text in ["ﬁ  x　y Ⅳ ㍿", "  Ünï CODE ", "ｱｲｳ á e​f", "plain", "   ", "①②", "x   y"]:
            ids, starts, ends = own.encode([text])[0]
            assert ids.tolist() == model.encode(text), (rule, trim, text)
            assert own.normalize(text)[0] == model.normalize(text)
            check_spans(model, text, ids, starts, ends)
            assert (starts <= ends).all() and (ends <= len(text.encode())).all() and (np.diff(starts) >= 0).all()


def test_warc(spark):
    rows = [(1, "http://a/é x\r\n", "same"), (9, "http://b", "same"), (5, None, "same"), (9, "http://b", "same"), (7, "u", None), (3, "u", ""), (None, "u", "same"), (4, "u", "big " * 200_000), (2, "u", "alone\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folder = warc.new_folder(spark)
    index = warc.write_bundles(pages, folder, frame_bytes=1000, bundle_bytes=500)
    got = warc.read_bundles(index, folder).collect()
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "revisit", 9), (9, "response", None), (5, "revisit", 9), (None, "revisit", 9), (7, "response", None), (3, "revisit", 7), (4, "response", None), (2, "response", None)}
    full = {r.page_id: r for r in got}
    assert full[1].payload is None and full[1].payload_bytes == 4 and full[4].payload == "big " * 200_000
    assert full[2].payload == "alone\r\n\r\nWARC/1.1" and full[7].payload_digest == warc.digest(b"")
    for r in index.collect():
        head, http, payload = warc.read_record(folder, r.bundle, r.frame_at, r.record_at)
        assert warc.page_of(head["warc-record-id"]) == r.page_id
    small = warc.write_bundles(pages, folder + "-2", least_bytes=10)
    assert warc.read_bundles(small, folder + "-2").where("record_type = 'revisit'").count() == 0
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), folder + "-3"), folder + "-3").count() == 0


def vectors(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v], label, "x", "x") for i, v, label in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string, rank string")


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 6)).round(1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    rows += [(100, data[3].tolist(), 0), (400, None, 0), (450, [1.0, None, 0, 0, 0, 0], 0), (500, [float("nan")] * 6, 0), (550, [float("inf")] * 6, 0), (600, [1.0, 2.0], 0), (None, data[0].tolist(), 0)]
    used = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, _ in rows[:301]]
    want = set()
    for n, (q, a) in enumerate(used):
        if q % 50 == 0:
            best = sorted((-int(a @ b), i, m) for m, (i, b) in enumerate(used) if m != n)[:5]
            want |= {(q, r, i, -s) for r, (s, i, _) in enumerate(best, 1)}
    for shard, block in ((16_384, 8_192), (64, 3)):
        got = kdtree.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=block)
        assert {tuple(r) for r in got.collect()} == want
    assert kdtree.top_k(vectors(spark, rows[:0]), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(4)
    rows = kdtree.exact((rng.normal(size=(4000, 3)) * 100).astype(np.int64))
    tree = kdtree.Tree(rows, 32)
    query = rows[7]
    bounds = tree.bounds(query[None])[0]
    best = kdtree.search(tree, rows[tree.order], tree.order, tree.order, query, bounds, 7, 5, None)
    want = sorted(((int(s), -i) for i, s in enumerate(rows @ query) if i != 7), reverse=True)[:5]
    assert sorted(((s, -i) for s, i, _ in best), reverse=True) == want
    leaves = [n for n, k in enumerate(tree.kids) if k[0] < 0]
    assert sum(bounds[n] >= want[-1][0] for n in leaves) < len(leaves) / 4
    big = kdtree.exact(np.array([[2**40, 1], [2**40, 3]]))
    assert int(big[0] @ big[1]) == 2**80 + 3


def plain_links(rows, least):
    import math

    out = {n: [] for n in range(len(rows))}
    ok = [lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=np.float32).astype(float), np.array(rows[b][1], dtype=np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    out[a].append(b)
                    out[b].append(a)
    return out


def test_vector_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.12 * rng.normal(size=16)).tolist(), int(i % 3 == 0)) for i in range(240)]
    rows += [(300, rows[0][1], 1), (301, rows[0][1], 1), (301, rows[0][1], 1), (302, rows[0][1], None), (303, [0.0] * 16, 1), (304, None, 1), (305, [float("nan")] * 16, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [None] * 16, 1)]
    links = plain_links(rows, 0.93)
    want = {}
    for n in range(len(rows)):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        want[n] = (rows[n][0], len(links[n]), min(rows[m][0] for m in seen))
    for chunk in (4096, 5):  # one chunk a list, and many that must meet
        monkeypatch.setattr(pq, "CHUNK", chunk)
        monkeypatch.setattr(pq, "LIST_ROWS", 40)
        got = pq.near_vectors(vectors(spark, rows)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want.values())
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert pq.near_vectors(vectors(spark, rows[:0])).count() == 0
    assert pq.near_vectors(vectors(spark, [(1, None, 1)])).count() == 1


def test_equal_vectors_only(spark):
    shown = lambda rows: sorted(tuple(r) for r in pq.near_vectors(vectors(spark, rows)).collect())
    same = [(i, [1.0, 2.0, 3.0], 1) for i in (7, 5, 9, 5)]
    assert shown(same) == [(5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (9, 3, 5, False)]
    # one point of each length, one row alone, one that can't link
    assert shown([*same[:2], (3, [1.0, 2.0], 1), (4, None, 1)]) == [(3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (7, 1, 5, False)]


def test_vector_recall(spark, sf_dir):
    """Share of brute-force links that many small lists still find."""
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    rows = [(int(i), [float(x) for x in v], int(k)) for i, v, k in zip(data.vec_id, data.embedding, data.label)]
    want = sum(map(len, plain_links(rows, 0.93).values()))
    got = pq.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert linededup.dedup_lines(none).count() == simhash.simhash_groups(none).count() == licenses.scan(none).count() == 0
    assert pii.mask(none).count() == 0 and packing.packed_documents(none, queries.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert pieces.encoded(none, queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_digest_is_plain_sha1():
    import base64

    assert warc.digest(b"x") == base64.b32encode(hashlib.sha1(b"x").digest()).decode()


def test_addresses_with_zero_parts(spark):
    from tests.llm.test_contract import KINDS, plain_pii

    rng = np.random.default_rng(13)
    parts = ["0", "00", "000", "010", "255", "256", "9", "99", "0255", "0256", "300", "1000", "0000000001"]
    texts = ["10.0.0.1", "127.0.0.1", "0.0.0.0", "192.168.0.12", "255.255.255.0", "256.0.0.0", "0" * 4_000 + ".0.0.1"]
    texts += [".".join(rng.choice(parts, 4)) for _ in range(300)] + [f"at {'.'.join(rng.choice(parts, int(n)))}, then" for n in rng.integers(2, 9, 200)]
    docs = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r[1] for r in pii.personal_data(docs).select("doc_id", pii.spans_text(F.col("base"))).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in plain_pii(text)), text
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert [masked[i] for i in range(6)] == ["[IP]"] * 5 + ["256.0.0.0"]


@pytest.mark.parametrize("piece", ["12345678 ", "10.0.0.1 ", "a@b.co,"])
def test_pii_work_grows_with_the_text(spark, piece):
    """Much of one kind of token in a single line: same base spans as the plain patterns, within seconds."""
    import time

    from tests.llm.test_contract import KINDS, plain_pii

    text = piece * (400_000 // len(piece))
    started = time.time()
    docs = frame(spark, [(1, text)])
    got = pii.personal_data(docs).select(pii.spans_text(F.col("base"))).first()[0]
    masked = pii.mask(docs).first().text
    assert time.time() - started < 60
    want = plain_pii(text)
    assert got == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert len(masked) == len(text) - sum(b - a - len(f"[{KINDS[k]}]") for a, k, b in want)
