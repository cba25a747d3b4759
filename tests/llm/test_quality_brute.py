"""The quality classifier against a plain version from the texts on."""

import collections
import math
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from lexiflow.llm import quality_classifier as Q
from lexiflow.llm.queries import QUERIES


def shares(text):
    """The eight ratios over their bad limits."""
    text = text or ""
    words = [w for w in regex.split("[\x20\x09-\x0D]+", text) if w]
    n, chars = max(len(words), 1), sum(map(len, words))
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if regex.search("[^\x20\x09-\x0D]", x)]
    letters = len(regex.findall(r"\p{L}", text))
    return (1 / n / 0.05, sum(c in "#*$%&|<>" for c in text) / n / 0.10,
            (len(lines) - len(set(lines))) / max(len(lines), 1) / 0.30, len(again) / n / 0.30,
            len(regex.findall(r"\p{Lu}", text)) / max(letters, 1) / 0.50, text.count("!") / n / 0.20, chars / n / 20.0,
            (1.0 - letters / max(chars, 1)) / 0.35)


def strength(groups):
    """Pseudo-count from [(good, n, prior mean)] by the method of moments."""
    spread = sum(n * (g / n - m) ** 2 for g, n, m in groups)
    within, scale = sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for _, n, m in groups)
    if not groups or not scale:
        return 1.0
    rho = (spread - within) / max(scale - within, 1e-9)
    return min(1000.0, max(1.0, 1 / rho - 1 if rho > 0 else 1000.0))


def brute(rows, labels):
    """doc_id -> (held_out, evidence, p_site, p_path, p_good) of [(doc_id, text, site, path)]."""
    bins = {i: [max(0, min(15, 3 + math.floor(-math.log2(max(x, 0.0) + 2.0 ** -12)))) for x in shares(t)] for i, t, _, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    known = {i: labels[i] for i, *_ in rows if i in labels and not held[i]}
    count = collections.Counter((f, b, known[i]) for i in known for f, b in enumerate(bins[i]))
    good, bad = sum(known.values()), len(known) - sum(known.values())
    mean = (good + 0.5) / (len(known) + 1)
    sites, paths = {}, {}
    for i, _, site, path in rows:
        if i in known:
            for table, key in ((sites, site), (paths, (site, path))):
                g = table.setdefault(key, [0, 0])
                g[0] += known[i]
                g[1] += 1
    k_site = strength([(g, n, mean) for g, n in sites.values()])
    k_path = strength([(g, n, (sites[s][0] + mean * k_site) / (sites[s][1] + k_site)) for (s, _), (g, n) in paths.items()])
    out = {}
    for i, _, site, path in rows:
        evidence = sum(math.log((count[f, b, 1] + 1) / (good + 16)) - math.log((count[f, b, 0] + 1) / (bad + 16))
                       for f, b in enumerate(bins[i]) if count[f, b, 1] + count[f, b, 0])
        own, one = known.get(i, 0), int(i in known)
        (sg, sn), (pg, pn) = sites.get(site, (0, 0)), paths.get((site, path), (0, 0))
        p_site = (sg - own + mean * k_site) / (sn - one + k_site)
        p_path = (pg - own + p_site * k_path) / (pn - one + k_path)
        out[i] = held[i], evidence, p_site, p_path, 1 / (1 + math.exp(-(evidence + math.log(p_path / (1 - p_path)))))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_equals_plain_version(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality is not None}
    want = brute(rows, labels)
    got = QUERIES["op2_quality_classifier"](spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == want[r.doc_id][0] and r.kept == (r.p_good >= 0.5)
        assert tuple(r)[2:6] == pytest.approx(want[r.doc_id][1:], abs=1e-9)


def test_sites_of_very_different_shares(spark):
    """Sites and paths that matter: strengths below their upper bound, sparse sites near the mean."""
    rows = [(i, "word " * (20 + i % 30) + f"w{i}", f"s{i % 7 if i < 900 else i}", f"p{i % 3}") for i in range(930)]
    labels = {i: int((i % 7 + i % 3) * 37 % 11 < 6) if i < 900 else i % 2 for i in range(930)}
    want = brute(rows, labels)
    frame = spark.createDataFrame(rows, "doc_id long, text string, site string, path string").repartition(5)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = Q.quality_classifier(frame, marks, F.col("site"), F.col("path")).collect()
    for r in got:
        assert tuple(r)[2:6] == pytest.approx(want[r.doc_id][1:], abs=1e-9)
