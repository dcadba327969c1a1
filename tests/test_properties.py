"""Property tests: the distributed operators equal brute force on random inputs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetgrade.functions.percentile import exact_percentiles
from fleetgrade.functions.substring_join import contains_any, contains_matches

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def brute_percentile(values, p):
    s = sorted(values)
    pos = p * (len(s) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or s[lo] == s[hi]:
        return float(s[lo])
    return (hi - pos) * s[lo] + (pos - lo) * s[hi]


groups = st.dictionaries(st.integers(0, 4), st.lists(st.integers(-10**6, 10**7), min_size=1, max_size=60),
                         min_size=1, max_size=4)


@SETTINGS
@given(data=groups, bits=st.sampled_from([0, 3, 16]), p=st.sampled_from([0.0, 0.5, 0.95, 0.99, 1.0]))
def test_exact_percentile_property(spark, data, bits, p):
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v bigint")
    got = {r["g"]: r["q"] for r in exact_percentiles(df, ["g"], "v", {"q": p}, bucket_bits=bits).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        exp = brute_percentile(vs, p)
        assert math.isclose(got[g], exp, rel_tol=1e-12, abs_tol=1e-6)


words = st.text(alphabet="abcAB-", min_size=0, max_size=8)


@SETTINGS
@given(texts=st.lists(st.tuples(st.integers(0, 2), words), min_size=1, max_size=12),
       pats=st.lists(st.tuples(st.integers(0, 2), words), min_size=0, max_size=6))
def test_contains_any_property(spark, texts, pats):
    left = spark.createDataFrame([(w, i, t) for i, (w, t) in enumerate(texts)], "ws int, id int, t string")
    right = spark.createDataFrame(pats or [(0, "")], "ws int, p string")
    got = sorted(r["id"] for r in contains_any(left, ["ws"], ["id"], "t", right, "p").collect())
    exp = sorted(i for i, (w, t) in enumerate(texts)
                 if any(w == pw and p and p.lower() in t.lower() for pw, p in (pats or [(0, "")])))
    assert got == exp


@SETTINGS
@given(texts=st.lists(words, min_size=1, max_size=10), pats=st.lists(words, min_size=1, max_size=6))
def test_contains_matches_without_keys_property(spark, texts, pats):
    left = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    right = spark.createDataFrame(list(enumerate(pats)), "pid int, p string")
    got = sorted((r["id"], r["pid"]) for r in contains_matches(left, [], ["id"], "t", right, "p", ["pid"]).collect())
    exp = sorted({(i, j) for i, t in enumerate(texts) for j, p in enumerate(pats) if p and p.lower() in t.lower()})
    assert got == exp
