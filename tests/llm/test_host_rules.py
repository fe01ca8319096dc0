import re
from collections import Counter

from rollcall.llm import host_rules as hr

from .data import SCHEMA, frame, rows, with_clashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
    return counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def test_counts(spark):
    got = hr.with_counts(with_clashes(frame(spark), "n_words")).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (tuple(r[c] for c in hr.COUNTS), r["base_failed"]) == brute(r["text"])


def verdicts(data, max_rate):
    hosts = {}
    for _, text, _, host, _ in data:
        n, f = hosts.get(host, (0, 0))
        hosts[host] = (n + 1, f + brute(text)[1])
    rates = [f / n for n, f in hosts.values()]
    m = sum(rates) / len(rates)
    few = sum(1 / n for n, _ in hosts.values()) / len(rates)
    v = (sum((x - m) ** 2 for x in rates) / len(rates) - m * (1 - m) * few) / (1 - few) if few < 1 else 0
    w = min(hr.MAX_WEIGHT, max(hr.MIN_WEIGHT, m * (1 - m) / v - 1)) if v > 0 else hr.MAX_WEIGHT
    return {h: (f + m * w) / (n + w) > max_rate for h, (n, f) in hosts.items()}


def test_hosts_and_filter(spark):
    data = rows() + [(900 + k, "too short", "en", "junk", 9) for k in range(30)] + [(990, "a fine text of more than ten words which stands alone on that host", "en", "junk", 9)]
    bad = verdicts(data, hr.MAX_RATE)
    assert bad["junk"] and not bad["a"]
    want = sorted(((r[0], r[1]) for r in data if not brute(r[1])[1] and not bad[r[3]]), key=str)
    kept = hr.filter_documents(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    judged = hr.judge(frame(spark, data)).collect()
    assert len(judged) == len(data)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in judged if r["kept"]) == sorted((x is None, x) for x, _ in want)


def test_prior_takes_out_the_noise_of_small_hosts(spark):
    """Hosts of three documents and one rate differ by chance alone: each is shrunk all the way to the common rate."""
    rows = [(f"h{k}", (k + j) % 4 == 0 or (j == 0 and k % 8 < 3)) for k in range(400) for j in range(3)]
    got = hr.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()
    seen = {r["n_failed"] / r["n_docs"] for r in got}
    assert max(seen) - min(seen) > 0.3 and max(r["shrunk_rate"] for r in got) - min(r["shrunk_rate"] for r in got) < 0.1
    # hosts of many documents that do differ keep their rates
    rows = [(f"h{k}", j < 100 * (k % 2) + 20) for k in range(10) for j in range(200)]
    got = hr.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()
    assert all(abs(r["shrunk_rate"] - r["n_failed"] / r["n_docs"]) < 0.01 for r in got)


def test_the_prior_is_that_which_rates_were_drawn_from(spark):
    """Rates drawn from a beta distribution, hosts of two or three documents: the fitted weight is that of the distribution."""
    import random

    for a, n in ((1, 2), (2, 3)):
        rng = random.Random(n)
        drawn = [(f"h{k}", rng.random() < p) for k in range(30_000) for p in [rng.betavariate(a, a)] for _ in range(n)]
        got = hr.host_verdicts(spark.createDataFrame(drawn, "source string, base_failed boolean"))
        # a host without failures has the rate m w / (n + w), one of failures only (n + m w) / (n + w)
        low, high = got.agg({"shrunk_rate": "min"}).first()[0], got.agg({"shrunk_rate": "max"}).first()[0]
        weight = n / (high - low) - n
        assert abs(weight - 2 * a) < 0.2 * a, (a, n, weight)


def test_hosts_of_one_document_are_one(spark):
    got = hr.host_verdicts(spark.createDataFrame([(f"h{k}", k < 3) for k in range(8)], "source string, base_failed boolean")).collect()
    assert all(abs(r["shrunk_rate"] - 3 / 8) < 1e-3 for r in got)


def test_columns_that_clash(spark):
    names = ("__row", "__host", "KEPT", "N_words", "host", "a.b", "Shrunk_Rate")
    docs = with_clashes(frame(spark), *names)
    assert sorted(map(str, hr.filter_documents(docs).select("doc_id", "text").collect())) == sorted(map(str, hr.filter_documents(frame(spark)).select("doc_id", "text").collect()))
    assert hr.filter_documents(docs).columns == docs.columns
    judged = hr.judge(docs)
    assert len({c.lower() for c in judged.columns}) == len(judged.columns) and {"__row", "__host", "host", "a.b", "kept", "n_words"} <= set(judged.columns)
    assert judged.count() == len(rows())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hr.judge(empty).count() == 0 and hr.filter_documents(empty).count() == 0
