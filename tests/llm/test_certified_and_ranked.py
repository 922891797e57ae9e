"""Whitening, ball-tree search and certified quality rules against plain versions, odd rows and hot groups."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from verdictframe.llm import balltree, quality, queries, whitening
from verdictframe.llm.common import table

INF, NAN = float("inf"), float("nan")


# whitening


def plain_whitening(vectors):
    """n, exact deviations, covariance and explained shares of the usable vectors, by Fractions."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, total = len(x), [sum(col) for col in zip(*x)]
    y = [[n * a - s for a, s in zip(row, total)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(len(total))] for i in range(len(total))])
    return n, [sum(a * a for a in r) for r in y], cov, np.array(y, dtype=float) / n


def check_whitening(rows, vectors, ids):
    n, deviation, cov, centred = plain_whitening(vectors)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    width = min(8, len(values))
    got = pd.DataFrame([r.asDict() for r in rows]).sort_values(["vec_id", "component"])
    assert len(got) == len(ids) * width and set(got.n) == {n}
    w = got.whitened.to_numpy().reshape(len(ids), width)
    order = np.argsort(ids)
    assert [int(d) for d in got.deviation[::width]] == [deviation[i] for i in order]
    assert np.allclose(got.explained[:width], values[:width] / values.sum(), rtol=1e-9)
    # Whitened coordinates determine unit eigenvectors up to the sign: V u = e u.
    axes = np.linalg.lstsq(centred[order], w * np.sqrt(values[:width]), rcond=None)[0]
    assert np.allclose(cov @ axes, axes * values[:width], rtol=0, atol=1e-7 * values[0])
    error = np.abs(np.cov(w.T, bias=True) - np.eye(width)).max()
    assert error < 1e-8 and set(got.identity_error) == {got.identity_error.iloc[0]} and got.identity_error.iloc[0] < 1e-8


def test_op11(spark, sf_dir):
    data = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    usable = [v is not None and all(c is not None and math.isfinite(c) for c in v) for v in data.embedding]
    data = data[usable]
    check_whitening(queries.QUERIES["op11_polarised_whitening"](spark, sf_dir).collect(), list(data.embedding), data.vec_id.to_numpy())


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, deviation int")


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [NAN] * 5), (103, [INF] * 5), (104, [])]
    got = whitening.whitened_components(vectors(spark, good + odd).repartition(5)).collect()
    check_whitening(got, [[np.float32(c) for c in v] for _, v in good], np.arange(40))
    repeated = whitening.whitened_components(vectors(spark, good + [good[0], good[0], (None, good[1][1])])).collect()
    assert Counter(r.vec_id for r in repeated)[0] == 15 and sum(r.vec_id is None for r in repeated) == 5 and repeated[0].n == 43
    assert whitening.whitened_components(vectors(spark, [])).count() == whitening.whitened_components(vectors(spark, odd)).count() == 0


def test_whitening_without_variance(spark):
    for rows in ([(1, [1.0, 2.0])], [(i, [0.5, -0.25]) for i in range(9)]):
        got = whitening.whitened_components(vectors(spark, rows)).collect()
        assert len(got) == 2 * len(rows)
        assert all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in got)
    flat = whitening.whitened_components(vectors(spark, [(i, [float(i), 2.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9


def test_whitening_of_several_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(3)
    short = [(i, [float(np.float32(c)) for c in rng.normal(size=2)]) for i in range(30)]
    huge = [(100 + i, [float(np.float32(c)) for c in rng.normal(size=3) * 1e12]) for i in range(20)]
    got = whitening.whitened_components(vectors(spark, short + huge)).collect()
    check_whitening([r for r in got if r.vec_id < 100], [v for _, v in short], np.arange(30))
    check_whitening([r for r in got if r.vec_id >= 100], [v for _, v in huge], np.arange(100, 120))
    beyond = whitening.whitened_components(vectors(spark, [(i, [3e38 * (-1) ** i, float(i)]) for i in range(6)])).collect()
    assert len(beyond) == 12 and {r.n for r in beyond} == {6}


# search


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or c in "0123456789abcdefghijklmnopqrstuvwxyz":
            word += c
        elif "A" <= c <= "Z":
            word += c.lower()
        elif word:
            out.append(word)
            word = ""
    return out


def plain_search(docs, items, k=10):
    parsed = [(i, Counter(plain_terms(t))) for i, t in docs]
    count, total = sum(bool(c) for _, c in parsed), sum(c.total() for _, c in parsed)
    df = Counter(t for _, c in parsed for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in parsed:
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    m = 100 - 75 + (75 * c.total() * count) // total
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, math.inf if i is None else i, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def search_frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", "y", 1) for d in docs], "doc_id long, text string, id string, terms string, n int"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"),
    )


ODD_TEXTS = [None, "", "!!! ---", "Über ÉTÉ école", "a1 B2_c3", "x" * 20_000, "the " * 30_000 + "needle", "naïve naïve   中文 中文", "KK k", "tab\tline\nnull\x00end"]


def test_search_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = [f"w{int(i)}" for i in range(80)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [docs[0]] * 30 + [(None, docs[1][1]), (None, docs[1][1]), (7, "other text of seven w1 w2")]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(12)] + [(50 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (None, docs[0][1])]
    d, q = search_frames(spark, docs, items)
    want = plain_search(docs, items)
    assert found(balltree.lexical_search(d.repartition(7), q)) == want
    empty_docs, empty_items = search_frames(spark, [], [])
    assert balltree.lexical_search(empty_docs, q).count() == balltree.lexical_search(d, empty_items).count() == 0
    assert balltree.lexical_search(empty_docs, empty_items).count() == 0


def test_search_in_small_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{int(i)}" for i in range(500)]
    docs = [(i, " ".join(rng.choice(words, 12))) for i in range(400)] + [(1000 + i, "hot copy of w1 w2 w3") for i in range(200)]
    items = [(i, " ".join(rng.choice(words, 4))) for i in range(20)] + [(99, "w1 w2 w3 hot")]
    monkeypatch.setattr(balltree, "SHARD_ROWS", 64)
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 20)
    d, q = search_frames(spark, docs, items)
    assert found(balltree.lexical_search(d.repartition(3), q)) == plain_search(docs, items)


def test_ball_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(2000):  # forty topics of their own words
        topic = i % 40
        rows.append(Counter((topic * 30 + rng.integers(0, 30, 15)).tolist()))
    start = np.r_[0, np.cumsum([len(r) for r in rows])]
    term = np.array([t for r in rows for t in r])
    value = np.array([c * 100_000 + 7 for r in rows for c in r.values()])
    tree = balltree.Balls(start, term, value, 16)
    for topic in (0, 3, 39):
        query = {topic * 30 + int(t): int(w) for t, w in zip(rng.choice(30, 6, replace=False), rng.integers(1, 9000, 6))}
        scores = np.array([sum(query.get(t, 0) * (c * 100_000 + 7) for t, c in r.items()) for r in rows])
        known = [(tree.place[t], w) for t, w in query.items()]
        bounds = tree.bounds(np.array([t for t, _ in known]), np.array([w for _, w in known]))
        for (a, b), bound in zip(tree.span, bounds):
            assert scores[tree.order[a:b]].max() <= bound
        best: list = []
        seen = tree.search(query, tree.order, best, 10, None)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
        assert seen < sum(k == (-1, -1) for k in tree.kids) / 2


def test_length_terms_beyond_64_bits():
    n = np.array([1, 10**7, 10**9])
    assert balltree.length_terms(n, 10**10, 10**13).tolist() == [25 + (75 * int(x) * 10**10) // 10**13 for x in n]


# quality


def plain_measures(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    lines = ["".join(x) for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    twice = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice)}


def plain_cutoffs(docs, labels, risk, error):
    """(stratum, rule) to cutoff, by exact binomial sums over fractions."""
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = good.get(i, False) or q > 0
    seen = {}
    for i, stratum, m in docs:
        if i in good and not (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]):
            words = max(1, m["n_words"])
            value = (m["n_symbols"] / words, m["word_chars"] / words, -(m["word_chars"] / words), m["n_dup_lines"] / max(1, m["n_lines"]), m["n_repeat_words"] / words)
            seen.setdefault(stratum or "", []).append((hashlib.md5(str(i).encode()).hexdigest() < "8", good[i], value))
    strata = sum(any(h and g for h, g, _ in rows) for rows in seen.values())
    tests = max(1, strata * sum(len(c) for _, c in quality.RULES))
    part = Fraction(risk / len(quality.RULES))
    out = {}
    for stratum, rows in seen.items():
        n = sum(h and g for h, g, _ in rows)
        fit_good, fit_bad = sum(not h and g for h, g, _ in rows), sum(not h and not g for h, g, _ in rows)
        for rule, (_, cutoffs) in enumerate(quality.RULES):
            for level, cut in enumerate(cutoffs, 1):
                k = sum(h and g and v[rule] > cut for h, g, v in rows)
                kg, kb = sum(not h and g and v[rule] > cut for h, g, v in rows), sum(not h and not g and v[rule] > cut for h, g, v in rows)
                tail = sum(math.comb(n, i) * part**i * (1 - part) ** (n - i) for i in range(k + 1))
                if n and tail <= Fraction(error) / tests and kb and kb * fit_good >= quality.LIFT * kg * fit_bad:
                    out[stratum, rule] = level
    return out


DOCS13 = "doc_id long, text string, source string, quality string, good string, n_words string, stratum int"


def labelled(spark, count=900):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(count):
        bad = rng.random() < 0.3
        words = [f"w{int(x)}" for x in rng.integers(0, 4000, 60)]
        if bad:
            words = [w + "#" * int(rng.integers(0, 4)) for w in words]
        docs.append((i, " ".join(words) + ("\nsame line" * 6 if bad and i % 2 else ""), None if i % 3 == 0 else f"s{min(2, i % 7)}"))
        if i % 10:
            labels.append((i, 0 if bad else 1))
    docs += [(2000, None, "s0"), (2001, "", "s0"), (None, docs[0][1], "s9"), (2003, docs[1][1] * 3, "unlabelled")] + [docs[2]] * 400
    labels += [(None, 1), (5, None), (7, 0), (7, 1), (99_999, 1)]
    frames = spark.createDataFrame([(*d, "x", "x", "x", 1) for d in docs], DOCS13), spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, stratum string")
    return docs, labels, *frames


def test_quality_verdicts_against_a_plain_version(spark):
    docs, labels, d, l = labelled(spark)
    options = {"risk": 0.5, "error": 0.2}
    measured = [(i, s, plain_measures(t)) for i, t, s in docs]
    want = plain_cutoffs(measured, labels, **options)
    facts = quality.measures(d).withColumn("levels", quality.levels())
    sound = facts.where(~quality.base_failed())
    assert {(r.stratum, r.rule): r.level for r in quality.certified(sound, l, **options).collect()} == {(s, r): len(quality.RULES[r][1]) + 1 - cut for (s, r), cut in want.items()} and want
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality_verdicts(d, l, **options).collect())
    plain = Counter()
    for i, stratum, m in measured:
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        words = max(1, m["n_words"])
        value = (m["n_symbols"] / words, m["word_chars"] / words, -(m["word_chars"] / words), m["n_dup_lines"] / max(1, m["n_lines"]), m["n_repeat_words"] / words)
        over = any(value[rule] > quality.RULES[rule][1][level - 1] for (s, rule), level in want.items() if s == (stratum or ""))
        plain[(i, m["n_words"], m["word_chars"], m["n_symbols"], m["n_lines"], m["n_dup_lines"], m["n_repeat_words"], base, not base and not over)] += 1
    assert got == plain
    assert 0 < sum(n for r, n in got.items() if not r[-1] and not r[-2])


def test_quality_without_labels_or_rows(spark):
    docs, _, d, l = labelled(spark, 60)
    out = quality.quality_verdicts(d, l.limit(0)).collect()
    assert len(out) == len(docs) and all(r.kept == (not r.base_failed) and r.failed_rules == [] for r in out)
    assert quality.quality_verdicts(d.limit(0), l).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "a b c a b", "a a a a", "a a a", "x y", "", "a\tb\nc\v a\fb\rc", "a\x1cb c a\x1cb c d", "  é 𝄞 é 𝄞 é 𝄞", "l\n\nl\n l\nl ", "w " * 20_000, " ".join(map(str, range(20_000))), "#*$%&|<>" * 9])
def test_measures(spark, text):
    got = quality.measures(spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")).first().asDict()
    assert {k: got[k] for k in plain_measures(text)} == plain_measures(text) and got["stratum"] == ""


@pytest.mark.parametrize("n,risk,error", [(0, 0.01, 0.05), (10, 0.01, 0.05), (300, 0.01, 0.05), (300, 0.1, 1e-4), (1000, 0.25, 1e-9), (5000, 0.01, 0.01)])
def test_critical_count_is_exact(spark, n, risk, error):
    got = spark.range(1).select(quality.critical_count(F.lit(n).cast("bigint"), risk, F.lit(error)).alias("k")).first().k
    part, total, want = Fraction(risk), Fraction(0), -1
    for k in range(n + 1):
        total += math.comb(n, k) * part**k * (1 - part) ** (n - k)
        if total > Fraction(error):
            break
        want = k
    assert got == want


def test_certificates_hold_on_fresh_documents(spark):
    """With no difference between good and bad, rules that were certified anyway reject at most their risk."""
    rng = np.random.default_rng(11)
    value = rng.random(8000)
    rows = [(i, "s", [int(sum(v > c for c in (0.99, 0.95, 0.9, 0.8, 0.5)))]) for i, v in enumerate(value)]
    rules = (("symbols_per_word", (0.99, 0.95, 0.9, 0.8, 0.5)),)
    facts = spark.createDataFrame(rows, "doc_id long, stratum string, levels array<int>")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(8000)], "doc_id long, quality int")
    (cut,) = quality.certified(facts, labels, rules, risk=0.12, lift=0.0).collect()
    assert cut.level == 3  # 0.9, the third of five, rejects a tenth; 0.8 would reject a fifth


def test_op13_takes_whole_tables(spark, sf_dir):
    got = queries.QUERIES["op13_certified_quality"](spark, sf_dir).toPandas().sort_values("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").toPandas().sort_values("doc_id")
    want = pd.DataFrame([plain_measures(t) for t in docs.text])
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        assert got[c].tolist() == want[c].tolist()


def test_op13_rejects_where_labels_suffice(spark, tmp_path):
    """By the query's own risk and error, sources of many good holdout labels get certificates and those of few don't."""
    rng = np.random.default_rng(13)
    docs = [(i, " ".join(f"w{int(x)}" + "#" * (i % 4 == 0) for x in rng.integers(0, 4000, 60)), "many" if i < 3000 else "few") for i in range(3400)]
    docs = pd.DataFrame(docs, columns=["doc_id", "text", "source"])
    docs.to_parquet(tmp_path / "documents.parquet")
    docs[docs.doc_id % 7 > 0].assign(quality=lambda d: (d.doc_id % 4 > 0).astype("int32"))[["doc_id", "quality"]].to_parquet(tmp_path / "labels.parquet")
    name = "op13_certified_quality"
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert compare(name, out, queries.ORACLES[name], connect(str(tmp_path))) is None
    got = out.toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and not got.base_failed.any()
    assert set(zip(got.source, got.doc_id % 4 == 0, got.kept)) == {("many", True, False), ("many", False, True), ("few", True, True), ("few", False, True)}
