"""Exact and near duplicates against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from incidentlab.llm import exact_dedup, simhash
from incidentlab.llm.components import _large_star, _small_star, components

from llm_fixtures import awkward, awkward_rows, frame, nothing, prose
from test_skew import skew_conf  # noqa: F401

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute_exact(rows):
    out, groups, kept = [], {}, set()
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in rows:
        ids = groups[r[1] or ""]
        top = max((i for i in ids if i is not None), default=None)
        first = r[0] == top and (r[1] or "") not in kept
        if first:
            kept.add(r[1] or "")
        out.append((r[0], top, len(ids), first, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup._sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1),
                                    lambda t: F.lit("same")])
@pytest.mark.parametrize("salts", [1, 5])
def test_exact_matches_brute_force_whatever_the_digest(spark, digest, salts):
    rows = awkward_rows() + [(100 + k, prose(k % 7, 9), "en", "a", 1) for k in range(40)]
    got = exact_dedup.exact_duplicates(frame(spark, rows).repartition(6), salts=salts, digest=digest)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == brute_exact(rows)


def test_exact_survivors_are_one_row_per_text(spark):
    docs = awkward(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = {}
    for r in awkward_rows():
        old = want.get(r[1] or "")
        want[r[1] or ""] = max((x for x in (old, r[0]) if x is not None), default=None)
    assert sorted(((r.text or "", r.doc_id) for r in rows), key=str) == sorted(want.items(), key=str)


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(nothing(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(nothing(spark)).count() == 0


def test_exact_plan_has_no_python(spark):
    plan = exact_dedup.exact_duplicates(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ")]
    words = [w for piece in words for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", piece)]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    par = {k: k for k in fps}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "A B c\x0bd e", prose(3, 700),
                                  "é ü Ä b c d", "no break a b c d"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(4)
    rows = [(k, prose(k // 4, 160), "en", "a", 1) for k in range(60)]
    for k in range(0, 60, 2):
        w = rows[k][1].split()
        w[r.randrange(len(w))] = "odd"
        rows[k] = (k, " ".join(w), "en", "a", 1)
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, "tiny", "en", "a", 0), (103, "tiny", "en", "a", 0)]
    fps = {i: brute_fingerprint(t or "") for i, t, *_ in rows}
    want = brute_components(fps)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    stay = {x.doc_id for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert stay == set(want.values())


def test_links_lose_no_pair(spark):
    """All pairs within four bits of random and perturbed fingerprints."""
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for n in range(1, 7):
            g = f
            for b in r.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    for bits in (0, 1, 3, 4, 6):
        got = sorted((x.a, x.b) for x in simhash.links(df, bits).collect())
        want = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
                if (fps[i] ^ fps[j]).bit_count() <= bits]
        assert got == want


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    assert {r.fingerprint for r in got if r.doc_id in (4, 5, 6)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(8) == 1 and 2 not in ids and 5 not in ids
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    par = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_group_of_copies_goes_back_in_pieces(skew_conf):
    """A third of the rows equal: the join back splits their digest."""
    # equal digests compress well: judged by bytes the hot partition is hardly larger here
    skew_conf.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1")
    docs = skew_conf.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = exact_dedup.exact_duplicates(docs)
    rows = got.collect()
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 30_000 and sum(r.kept for r in rows) == 20_001
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3 == 0} == {(29_997, 10_000)}


def test_hub_with_many_neighbours_is_split(skew_conf):
    star = skew_conf.range(1, 30_001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    tail = skew_conf.range(100_000, 160_000, 2).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    e = star.unionByName(tail)
    for step in (_large_star(e), _small_star(e.select(F.col("v").alias("u"), F.col("u").alias("v")))):
        rows = step.collect()
        assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()
        assert len(rows) >= 30_000
    found = {r.node: r.component for r in components(e.select(F.col("u").alias("a"), F.col("v").alias("b"))).collect()}
    assert len(found) == 90_001 and all(found[k] == 0 for k in range(30_001))
    assert all(found[k] == k - k % 2 for k in range(100_000, 160_000))
