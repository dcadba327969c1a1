"""The training-data operators against plain Python, the library and DuckDB SQL."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from fleetgrade.llm import class_lm, common, jaccard_join, licenses, mixing, pii, quality, sentencepiece_bpe, toxicity, url_filters, vector_topk
from fleetgrade.llm.registered import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.conftest import SF001, SF01

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"), (5, "x " * 30_000),
       (6, "Zoë ▁ <s> 😀\u0085 a@b.co +1 (988) 555-2485"), (7, "same text " * 20), (8, "same text " * 20)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return (spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
            .withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("key", F.lit("x")).withColumn("n", F.lit(1)).withColumn("_kept", F.lit(2)))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql(spark, key):
    ok, message = compare(spark, SF01, key, QUERIES[key], ORACLES[key], duck(SF01))
    assert ok, message


def test_vectors_ties_nulls_and_lengths(spark):
    random.seed(4)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(12)]) for i in range(400)]
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (None, [1.0] * 12), (450, [1.0, 1.0])]
    got = vector_topk.top_k(*(spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(c)
                              for c in ("vec_id % 50 = 0", "true"))).collect()
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and not math.isnan(x) for x in v)]
    want = {}
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:5]
            want.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)})
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def _python_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for i, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_base_and_discovery(spark, odd):
    hard = ["a@b.com+x@c.org é 1.2.3.4.5.6.7.8 4111 1111 1111 1111 300.1.1.1 0255.1.2.3", "@a@b@c.d..e +12--((..  3" + "9" * 30,
            "a" * 5000 + "@" + "b." * 3000 + "c", "1.2.3.4.5 1..2.3.4 x.y@z +1+1234567890 4111-1111-1111-1111-"]
    seeds = [f"please contact id user{i}@ex.com now" for i in range(8)] + ["then contact id ab-12345 now"]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(20 + i, t) for i, t in enumerate(hard + seeds)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in df.collect()}
    rows = pii.find(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(_python_spans(text[r.doc_id]).encode()).hexdigest()
    assert next(r.spans for r in rows if r.doc_id == 32).startswith("email:16:24")  # found by its context alone
    masked = {r.doc_id: r for r in pii.mask(odd).collect()}
    assert masked[6].text.endswith("<email> <phone>") and masked[6].n_chars == len(masked[6].text) and masked[1].text is None
    assert pii.mask(odd).columns == odd.columns


def test_pii_unseen_values_and_spaced_phones(spark):
    own = ["z" + a + b for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i, f"w{i} contact id user{i}@ex.com {z}" if i < 60 else f"w{i} contact id ab-{i}999 {z}") for i, z in enumerate(own)]
    rows += [(100 + i, f"q{i} ring desk {'+49 30 555' if i < 30 else '(030) 555'}-12{i:02d}, y{i}") for i in range(50)]
    rows += [(200 + i, f"v{i} paid bill {f'(030) 555-34{i:02d}' if i else '+49 30 555-3400'} x{i}") for i in range(40)]
    rows += [(300, "1 " * 500 + "1a"), (301, "see (030 555 1234) 2 pages")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    print("unseen masked", sum(got[i] == f"w{i} contact id <email> {own[i]}" for i in range(60, 100)), "of 40; spaced phones masked",
          sum(got[100 + i] == f"q{i} ring desk <phone>, y{i}" for i in range(30, 50)), "of 20")
    for i in range(100):
        assert got[i] == f"w{i} contact id <email> {own[i]}"
    for i in range(50):
        assert got[100 + i] == f"q{i} ring desk <phone>, y{i}"
    assert all(got[i] == t for i, t in rows if 200 < i)  # one known value does not make a context


def test_toxicity_held_out(spark):
    rows = toxicity.op3_toxicity(spark, SF01).join(common.table(spark, SF01, "labels"), "doc_id").where("held_out").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_learns(spark):
    random.seed(2)
    plain = ["river", "stone", "light", "paper", "window", "garden"]
    rows = [(i, " ".join(random.choices(plain, k=30)) + (" vilebad" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(df, toxicity.fit(df, df)).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out)


def test_sentencepiece_equals_library(spark, odd):
    import sentencepiece as spm

    path = sentencepiece_bpe.default_model()
    lib, own = spm.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Bpe(sentencepiece_bpe.read_model(path))
    random.seed(1)
    parts = ["a", "th", "ing", " ", "  ", "▁", "\n", "é", "中", "😀", "<s>", "<0x0A>", "\t", "0", " " * 17, "̀", "aaaa"]
    for text in [t for _, t in ODD if t] + ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(5000)]:
        ids = lib.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids)
    rows = sentencepiece_bpe.token_digests(odd, path).collect()
    assert collections.Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == collections.Counter(
        (len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(lib.decode(i).encode()).hexdigest())
        for i in (lib.encode(t or "") for _, t in ODD))


def test_language_model_base_counts(spark):
    docs = common.table(spark, SF001, "documents")
    count, toks = collections.Counter(), {}
    for r in docs.collect():
        toks[r.doc_id] = (r.text or "").encode().lower().split() + [b""]
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            count.update(toks[r.doc_id])
    total, distinct = sum(count.values()), len(count)
    rows = class_lm.score_documents(docs).collect()
    assert len(rows) == len(toks)
    for r in rows:
        want = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in toks[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_tokens == len(toks[r.doc_id])
        assert r.n_known == sum(count[w] > 0 for w in toks[r.doc_id]) and r.train_tokens == total
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_url_odd(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Org/x"), (4, "http://a.ORG"), (5, "x://b.com/de/q?utm_source=1"), (6, "x://c.net/?utm_source=1"), (6, "x://c.net/?utm_source=1")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == [(1, "", "", None, "block"), (2, "", "", None, "block"), (3, "org", "/x", "org/", "allow"), (4, "a.org", "", None, "allow"),
                   (5, "b.com", "/de/q", "com/de/", "block"), (6, "c.net", "/", None, "block"), (6, "c.net", "/", None, "block")]


def test_url_query_beside_host(spark):
    rows = [(1, "http://shop.net?u=x.com/de/"), (2, "http://shop.net?u=x.org/"), (3, "http://shop.net?u=/x.org/&utm_source=1"),
            (4, "http://a.com/de/?u=x.org/"), (5, "http://shop.net#x.com/de/")]
    got = sorted((r.page_id, r.rule, r.verdict, r.pattern_rule) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == [(1, None, "allow", None), (2, None, "allow", None), (3, None, "block", "tracking"), (4, "com/de/", "block", None),
                   (5, None, "allow", None)]


def _groups(rows, k, num):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, k, num):
    random.seed(num)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for size in (2, 3, 6, 9, 11, 12, 20, 22, 30, 60, 120):
        base = random.choices(vocabulary, k=size)
        for _ in range(14):
            words = list(base)
            for _ in range(random.randint(0, 3)):
                if random.random() < 0.5:
                    words[random.randrange(len(words))] = random.choice(vocabulary)
                else:
                    words.insert(random.randrange(len(words)), random.choice(vocabulary))
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _groups(rows, k, num)


def test_licences(spark, odd):
    a = licenses.Automaton()
    random.seed(5)
    texts = [t for _, t in licenses.TEMPLATES + licenses.PHRASES]
    for _ in range(500):
        ws = []
        while len(ws) < 40:
            ws += licenses.plain_words(random.choice(texts))[: random.randint(1, 14)] if random.random() < 0.4 else [random.choice(list(a.number))]
        want = sorted((i, a.n_templates + j) for j, (p, _) in enumerate(licenses.PHRASES) for i in range(len(ws))
                      if ws[i: i + len(p.split())] == p.encode().split())
        assert sorted(a.stream(ws)[0]) == want
    full = dict(licenses.TEMPLATES)["gpl"]
    got = licenses.scan_documents(spark.createDataFrame([(1, f"intro words {full} and more"), (2, None)], "doc_id long, text string")).collect()
    assert [(r.labels, r.n_base, r.score) for r in got] == [("gpl", 0, 1.0), ("", 0, 0.0)] and got[0].spans[0].first == 2


def test_mixing_meets_targets(spark):
    rows = [(i, ("a", "b")[i % 3 == 0], ("en", "de")[i % 5 == 0], "word " * (10 + i % 7)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = mixing.calibrate(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}}).collect()
    total = sum(r._tokens * r._prob for r in got)
    for name, share in (("a", 0.5), ("b", 0.5)):
        assert abs(sum(r._tokens * r._prob for r in got if r._source == name) / total - share) < 1e-3
    kept = sum(r._tokens for r in got if r._kept)
    assert abs(kept / total - 1) < 0.05


def test_mixing_one_document_source(spark):
    def share(extra):
        rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", ("en", "de")[i % 5 == 0], "word " * (90 + i % 21)) for i in range(6000)]
        docs = spark.createDataFrame(rows + extra, "doc_id long, source string, lang string, text string")
        got = mixing.calibrate(docs).collect()
        main = [r for r in got if r._source not in ("stray", "") and not r._source.startswith("t")]
        return (sum(r._tokens * r._prob for r in main) / sum(r._tokens for r in main),
                sum(r._tokens * r._prob for r in got) / sum(r._tokens for r in got), [r._prob for r in got if r not in main])

    alone, _, _ = share([])
    beside, _, rare = share([(9000, "stray", "en", "word " * 100), (9001, None, None, "word " * 100)])
    print("kept share", alone, beside)
    assert abs(beside - alone) < 0.02 and rare == [1.0, 1.0]
    _, tail, _ = share([(9000 + i, f"t{i}", "en", "word " * 100) for i in range(200)])
    print("kept share with 200 sources of one document", tail)
    assert tail >= 0.3 - 1e-9


def test_odd_rows_and_empty_tables(spark, odd):
    import corpus_pipeline

    empty = odd.where("false")
    assert quality.judge(odd).count() == len(ODD) and [r.kept for r in quality.judge(odd).where("doc_id <= 4").collect()] == [False] * 5
    assert licenses.scan_documents(odd).count() == len(ODD)
    assert class_lm.score_documents(odd).count() == len(ODD)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(odd, 3, 90, 100).collect()}
    assert got[7] == got[8] == 7 and got[1] == 1 and got[None] is None
    assert mixing.sample(odd).columns == odd.columns
    assert toxicity.score(odd, toxicity.fit(odd, odd.selectExpr("doc_id", "cast(null as int) as toxic"))).count() == len(ODD)
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF001).collect(), stage(spark, docs, SF001).schema)
            assert name == "encode" or docs.columns == odd.columns
    for f in (quality.judge, licenses.scan_documents, class_lm.score_documents, pii.find, mixing.calibrate):
        assert f(empty).count() == 0
    assert jaccard_join.jaccard_components(empty, 3, 90, 100).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_topk.top_k(none, none).count() == 0
