"""Operators of DataFrame functions: rules, mixing, personal data, URLs, exact copies."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from raterkit.llm import exact, mixing, pii, piisample, quality, urls
from raterkit.session import materialize, scratch_path
from tests.llm import brute, odd

WORD = brute.WORD


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def failed(n, chars, symbols, lines, dup, repeat):
    tests = [n < 50, 100 * repeat > 50 * n, chars < 2 * n or chars > 20 * n, 100 * symbols > 30 * n, 100 * dup > 50 * lines]
    return sum(1 << i for i, t in enumerate(tests) if t)


def test_quality_ledger(spark):
    got = quality.apply_policy(quality.ledger(odd.table(spark))).collect()
    want = [(d, *measured(t)) for d, t in odd.texts()]
    assert sorted([(r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        bits = failed(*(r[m] for m in quality.MEASURES))
        assert (r["failed"], r["base_failed"], r["kept"]) == (bits, bits & 3 != 0, bits == 0)


def test_quality_policies_and_ablations(spark):
    entries = materialize(quality.ledger(odd.table(spark)), "ledger")
    bits = [failed(*measured(t)) for _, t in odd.texts()]
    for version, names in quality.POLICIES.items():
        mask = quality.mask_of(names)
        assert quality.apply_policy(entries, version).filter("kept").count() == sum(b & mask == 0 for b in bits)
        for r in quality.ablations(entries, version).collect():
            one = quality.mask_of((r["rule"],))
            assert r["n_failed"] == sum(b & one != 0 for b in bits)
            assert r["n_failed_alone"] == sum(b & mask == one for b in bits)
            assert r["n_kept_without"] == sum(b & mask & ~one == 0 for b in bits)


def test_quality_stage_keeps_rows_unchanged(spark):
    docs = odd.table(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if failed(*measured(r["text"])) == 0]
    assert sorted(kept.collect(), key=repr) == sorted(want, key=repr)
    assert quality.keep_good(odd.empty(spark)).count() == quality.ledger(odd.empty(spark)).count() == 0


def share(*parts):
    text = ":".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)


def poisson(rate, u):
    k, total = 0, math.exp(-rate)
    p = total
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_mix(spark, weights):
    docs = odd.table(spark)
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    share_of = {s: n**0.5 for s, n in size.items()} if weights is None else {s: weights.get(s, 0.0) for s in size}
    rate = {s: share_of[s] / sum(share_of.values()) * sum(size.values()) / size[s] for s in size}
    got = mixing.mix(docs, weights)
    found = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    want, ordinals = Counter(), Counter()
    for r in sorted(rows, key=lambda r: str(r["source"])):
        same = r["doc_id"], r["text"]
        ordinals[same] += 1
        want[(*same, r["source"])] += poisson(rate[r["source"]], share(mixing.SEED, r["doc_id"], digest(r["text"]), ordinals[same]))
    several = {(d, t) for (d, t), n in ordinals.items() if n > 1}  # it is open which of them has which ordinal
    assert {k: v for k, v in found.items() if k[:2] not in several} == {k: v for k, v in (+want).items() if k[:2] not in several}
    assert several
    assert set(got.columns) == set(docs.columns) | {"shuffle_key"}
    whole = mixing.mixed(docs, weights=weights)
    assert whole.schema == docs.schema  # a column named copy keeps its own values
    assert Counter(map(tuple, whole.collect())) == Counter(tuple(r[c] for c in docs.columns) for r in got.withColumn("copy", F.lit("c")).collect())
    assert mixing.mix(odd.empty(spark), weights).count() == 0


def digest(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["text {}", "one text"])
def test_mix_with_a_third_of_the_ids_null(spark, text):
    """Null ids, with different texts or one, are drawn one by one and spread over the tasks."""
    rows = [(None if i % 3 == 0 else i, text.format(i), f"s{i % 2}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for seed in ("a", "b", "c"):
        got = mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, seed=seed)
        sizes = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
        nulls = got.filter("doc_id IS NULL").count()
        total, each = sum(len(r[1]) for r in rows), sum(len(r[1]) for r in rows) / len(rows)
        for name, share_of in (("s0", 0.75), ("s1", 0.25)):
            assert abs(sizes[name] - share_of * total) < 3.5 * each * (share_of * len(rows)) ** 0.5
        assert abs(nulls - 3000) < 3.5 * 3000**0.5
        tasks = sorted(r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert tasks[-1] < 2 * tasks[len(tasks) // 2]


def test_poisson_table_reaches_any_share(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 40.0), ("d", 900.0)], "source string, rate double")
    for r in mixing.poisson_tables(rates).collect():
        assert abs(r["cdf"][-1] - 1) < 1e-9
        assert all(x <= y for x, y in zip(r["cdf"], r["cdf"][1:]))


def test_mix_with_many_sources_uses_the_join(spark, monkeypatch):
    docs = odd.table(spark)
    want = Counter(tuple(r) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert Counter(tuple(r) for r in mixing.mix(docs).collect()) == want


def url_rows():
    return [
        (1, "http://a.Example.COM/de/x?q"),
        (2, "https://example.com/DE/"),
        (3, "http://notexample.com/de/"),
        (4, "http://example.net/en/1"),
        (5, "http://b.example.net/fr/"),
        (6, "http://x.org/fr/"),
        (6, "http://x.org/fr/"),
        (7, "http://net"),
        (8, "example.net/en/"),
        (9, None),
        (None, "ftp://deep.example.net/en/#f"),
        (10, "://"),
        (11, "http://net/?a://b"),
        (12, "http://EXAMPLE.net?x"),
        (13, ""),
        (14, "http://" + "a." * 60 + "net/" + "p/" * 5000),
    ]


def url_rules():
    return [*urls.RULES, ("block", "a.example.com", ""), ("allow", "a.example.com", "/de/x"), ("allow", "NET", "/"), ("block", None, "/"), ("block", "", "/")]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(brute._LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [
        (len(h + p), v == "block", h + p, v)
        for v, h, p in ((v, (h or "").lower(), p) for v, h, p in rules)
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [urls.RULES, url_rules(), []])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in url_rows()], "page_id long, url string, host string, key string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = [tuple(r) for r in urls.match(pages, table).collect()]
    assert sorted(got, key=repr) == sorted([(i, *judged(u, rules)) for i, u in url_rows()], key=repr)
    assert urls.match(pages.limit(0), table).count() == 0


def exact_brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((d, t or ""))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        once = True
        for m in members:
            out.append((m[0], best[0], len(members), m == best and once, hashlib.sha256(body.encode()).hexdigest()))
            once = once and m != best
    return sorted(out, key=repr)


def weak(body):
    return F.substring(F.md5(body), 1, 1)


@pytest.mark.parametrize("digest, files", [(exact.sha256, None), (exact.sha256, 1), (weak, None)])
def test_exact(spark, digest, files):
    got = exact.decide(odd.table(spark), digest=digest, files_per_batch=files).collect()
    assert sorted((tuple(r) for r in got), key=repr) == exact_brute(odd.texts())


def test_exact_state_goes_on_with_new_files(spark):
    path = scratch_path(spark, "feed")
    state = scratch_path(spark, "state")
    for part in (odd.texts()[:8], odd.texts()[8:]):
        feed = exact.make_feed(odd.table(spark, part), "doc_id", "text", exact.sha256, f"{path}/{len(part)}")
        feed.write.mode("append").parquet(f"{path}/all")
        groups = exact.stream_groups(spark, f"{path}/all", feed.schema, state)
    want = {r[4]: (r[1], r[2]) for r in exact_brute(odd.texts())}
    assert {r["digest"]: (r["best"]["doc_id"], r["n"]) for r in groups.collect()} == want


def test_exact_stage(spark):
    docs = odd.table(spark)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    want = [r[0] for r in exact_brute(odd.texts()) if r[3]]
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted(want, key=repr)
    assert exact.decide(odd.empty(spark)).count() == exact.keep_one(odd.empty(spark)).count() == 0


def pii_rows():
    import random

    rnd = random.Random(5)
    bits = ["a@b.co", "%x@y.zz", "é", "@", " ", "1.2.3.4", "999.1.1.1", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456 78", "+1", "+123456789", "a.b.c", "-", "--", "0", "12", ".", ",", "\n", "x@y", "(030) 123 4567", "👍"]
    rows = [(100 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(300)]
    # brute force is quadratic on runs, so these stay short; the operator takes any length
    return rows + [(1000, "1.2." * 300), (1001, "a@" + "b." * 10_000 + "c"), (1002, "+1" + " " * 50_000), (1003, "a.b@c " * 2000)]


@pytest.fixture(scope="module")
def detector_and_proposals(spark):
    docs = odd.table(spark, odd.texts() + pii_rows())
    proposals = materialize(pii.proposals_of(docs), "proposals")
    return docs, proposals, pii.fit(proposals)


def test_pii_base_spans(detector_and_proposals):
    docs, proposals, detector = detector_and_proposals
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = []
    for d, t in texts:
        spans = brute.base_spans(t)
        names = [f"{k}:{a}:{b}" for k, a, b in spans]
        want.append((d, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(",".join(names).encode()).hexdigest()))
    got = pii.describe(proposals, detector).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    by_id = {r["doc_id"]: r for r in got}
    for d, t in texts:
        spans = [f"{k}:{a}:{b}" for k, a, b in brute.base_spans(t)]
        found = by_id[d]["spans"].split(",") if by_id[d]["spans"] else []
        assert set(spans) <= set(found) or d in (None, 5)
        assert len(found) == len(set(found)) == sum(by_id[d][f"n_{k}"] for k in pii.KINDS) + by_id[d]["n_added"]


def test_pii_long_runs(spark):
    """Far beyond what a backtracking or recursive pattern could stand."""
    rows = [(1, "a" * 500_000), (2, "1" * 300_000), (3, "1.2.3.4." * 50_000), (4, "x." * 200_000 + "@b.c"), (5, "1 " * 100_000)]
    proposals = materialize(pii.proposals_of(odd.table(spark, rows)), "proposals")
    got = {r["doc_id"]: r for r in pii.describe(proposals, pii.Detector([], {})).collect()}
    assert [got[d][f"n_{k}"] for d in (1, 2, 5) for k in pii.KINDS] == [0] * 12
    assert got[3]["n_ip"] == 50_000 and got[4]["n_email"] == 1


def test_pii_trees_as_columns_agree_with_the_model(spark):
    import random

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rnd = random.Random(2)
    rows = [([x := rnd.random(), y := rnd.random(), float(i % 3)], float(x + y * (i % 3) > 0.9)) for i in range(400)]
    data = spark.createDataFrame(rows, "f array<double>, label double").withColumn("features", array_to_vector("f"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(data)
    detector = pii.Detector([(w, pii._read_tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)], {})
    scored = model.transform(data).select(detector.probability(F.col("f")).alias("p"), vector_to_array("probability")[1].alias("q"))
    assert all(abs(r["p"] - r["q"]) < 1e-9 for r in scored.collect())


def test_pii_learns_local_numbers_in_context(spark):
    rows = []
    for i in range(400):
        rows.append((2 * i, f"please call +49 30 {i:03d} {1000 + i} today"))
        rows.append((2 * i + 1, f"version 1.{i}.2 of part {i:03d}-{i:02d} costs {i}.50"))
    rows += [(9000 + i, f"please call +4 30 {i:03d} 1{i} today") for i in range(5)]
    proposals = materialize(pii.proposals_of(odd.table(spark, rows)), "proposals")
    detector = pii.fit(proposals)
    described = {r["doc_id"]: r for r in pii.describe(proposals, detector).collect()}
    assert all(described[2 * i]["n_phone"] == 1 for i in range(400))
    assert sum(described[2 * i + 1]["n_added"] for i in range(400)) == 0


def luhn_card(n):
    def total(number):
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(number))]
        return sum(v - 9 if v > 9 else v for v in doubled)

    return next(x for c in range(10) if total(x := f"4{n:014d}{c}") % 10 == 0)


def test_pii_adds_loose_forms_and_no_version_or_part_numbers(spark):
    loose, other = [], []
    for i in range(150):
        card = luhn_card(31_622_776 * (i + 7))
        dotted = ".".join(card[k : k + 4] for k in range(0, 16, 4))
        loose.append((0, f"joe{i} (at) site{i} (dot) com", f"you may reach joe{i} (at) site{i} (dot) com any time"))
        loose.append((3, f"(030) {200 + i} {4567 + i}", f"so call (030) {200 + i} {4567 + i} at night"))
        loose.append((2, dotted, f"he paid by card {dotted} at last"))
        other.append(f"install version 12.{i % 9}.{100 + i}.{4000 + i} of it")
        other.append(f"fit part {10 + i % 80}-{2000 + i}-{300 + i} there")
    base = [f"mail ann{i}@host{i}.org or call +49 30 {200 + i} {4000 + i}, card {luhn_card(10**9 + 77 * i)} and {i % 250}.2.3.4" for i in range(300)]
    texts = [t for *_, t in loose] + other + base
    proposals = materialize(pii.proposals_of(odd.table(spark, list(enumerate(texts)))), "proposals")
    detector = pii.fit(proposals)
    found = {r["doc_id"]: r for r in pii.describe(proposals, detector).collect()}
    for kind in (0, 2, 3):
        of_kind = [(i, k, m, t) for i, (k, m, t) in enumerate(loose) if k == kind]
        added = [f"{pii.KINDS[k]}:{t.index(m)}:{t.index(m) + len(m)}" in found[i]["spans"].split(",") for i, k, m, t in of_kind]
        assert sum(added) >= 0.9 * len(added), pii.KINDS[kind]
    assert sum(found[len(loose) + i]["n_added"] for i in range(len(other))) == 0
    for kind in ("email", "ip", "card", "phone"):
        assert sum(found[len(loose) + len(other) + i][f"n_{kind}"] for i in range(len(base))) == len(base)


@pytest.fixture(scope="module")
def document_detector(spark, sf_dir):
    proposals = materialize(pii.proposals_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "proposals")
    return proposals, pii.fit(proposals)


def test_pii_on_sentences_that_trees_and_thresholds_have_not_seen(spark, document_detector):
    _, detector = document_detector
    seen = pii.labelled_proposals(spark, piisample.TEST).select("truth", F.explode("seen").alias("s")).filter("NOT s.confirmed")
    judged = seen.select("truth", "s.kind", detector.accepts(F.col("s")).alias("added")).collect()
    added = [r for r in judged if r["added"]]
    precision = sum(r["kind"] == r["truth"] for r in added) / len(added)
    recall = {k: [r["added"] for r in judged if r["kind"] == r["truth"] == k] for k in (0, 2, 3)}
    print("precision", precision, "recall", {pii.KINDS[k]: sum(v) / len(v) for k, v in recall.items()})
    assert precision >= 0.95
    assert all(sum(v) >= 0.6 * len(v) for v in recall.values())


def test_pii_parts_of_the_sample_have_no_common_sentence():
    parts = [{s for _, s in sentences} for sentences in piisample.SENTENCES.values()]
    assert sum(map(len, parts)) == len(set().union(*parts))
    for sentences in piisample.SENTENCES.values():
        cued = {(kind is not None) for kind, s in sentences if re.search("|".join(pii._CUES.values()), s.lower())}
        assert cued == {True, False}


def test_pii_hard_negatives_and_tokens(spark, document_detector):
    """What a cue word alone would have let in, and what it would have kept out."""
    _, detector = document_detector
    none = [
        "telephone sales rose 1995 2005 2015", "call 12345678 units", "the phone 2021-2022", "telecom index 100.25.30.45.11",
        "phone x9170a161913d4d019930026318f5d ended", "call id a12345678901234 now", "card 4537855499667849 base", "phone 4111 1111 1111 1111 x",
    ]
    some = ["Tel.: 0171/1234567", "contact sales at 1-800-555-0199"]
    rows = materialize(pii.proposals_of(odd.table(spark, list(enumerate(none + some)))), "proposals")
    found = {r["doc_id"]: r for r in pii.describe(rows, detector).collect()}
    assert [found[i]["n_added"] for i in range(len(none))] == [0] * len(none)
    assert [found[len(none) + i]["n_added"] for i in range(len(some))] == [1, 1]


def test_pii_added_spans_stand_alone(document_detector, spark, sf_dir):
    proposals, detector = document_detector
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.describe(proposals, detector).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        base = {(k, a, b) for k, a, b in brute.base_spans(texts[r["doc_id"]])}
        for kind, begin, end in set(spans) - base:
            text = texts[r["doc_id"]]
            assert not text[begin - 1 : begin].isalnum() and not text[end : end + 1].isalnum()
            assert not any(k != kind and a < end and begin < b for k, a, b in base)


def test_pii_rare_kinds_get_thresholds(spark):
    docs = odd.table(spark, [(i, f"number {i}-{1000 + i}-{20 + i}") for i in range(10, 60)])
    assert set(pii.fit(materialize(pii.proposals_of(docs), "rare")).thresholds) == {0, 2, 3}


def test_pii_threshold_is_calibrated():
    ranked = [(1 - i / 100, 1.0) for i in range(60)] + [(0.3, 0.0)] * 40
    assert pii._calibrated(ranked, 0.98) == pytest.approx((1 - 59 / 100 + 0.3) / 2)
    assert pii._calibrated(ranked[:20], 0.98) is None
    assert pii._calibrated([(0.5, 0.0)] * 100, 0.98) is None


def test_pii_learns_from_every_row_of_the_table(spark):
    """More rows of a kind and label than any sample held; each counts, and weighs its part."""
    docs = [(i, f"call +49 30 {100 + i % 800} {1000 + i} or see lot {10 + i % 80}-{2000 + i}-{300 + i % 600}") for i in range(3000)]
    proposals = materialize(pii.proposals_of(odd.table(spark, docs)), "every")
    seen = [s for r in proposals.select("seen").collect() for s in r["seen"]]
    want = {(3, 1.0): sum(s["confirmed"] + bool(s["loose"]) for s in seen), (3, 0.0): sum(s["other"] for s in seen)}
    rows = materialize(pii._corpus_rows(proposals), "rows")
    found = {(r["kind"], r["label"]): r["n"] for r in rows.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    assert found == want and want[3, 1.0] == 6000 and want[3, 0.0] == 3000
    heavy = pii._weighted(rows, 800).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(100) for r in heavy) and len(heavy) == 2


def test_pii_fits_few_rows_in_one_task(spark, monkeypatch):
    """Also in a session that deals keys out to more partitions than it is asked for."""
    frame, parts = type(spark.range(0)), []
    proposals = materialize(pii.proposals_of(odd.table(spark, pii_rows())), "few")
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by, f=frame.repartition: f(self, max(7, n) if by else n, *by))
    monkeypatch.setattr(pii, "_trees_of", lambda kind, train, size: parts.append((train.rdd.getNumPartitions(), train.count() == size)) or [])
    pii.fit(proposals)
    assert parts and set(parts) == {(1, True)}


def test_pii_redaction_and_empty_table(spark, detector_and_proposals):
    detector = pii.Detector([], {})
    docs = odd.table(spark)
    clean = pii.redact(docs, detector)
    assert clean.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[16].endswith("mail [email] or call [phone] now, card [card]")
    assert by_id[6] is None and by_id[1] == odd.texts()[0][1]
    none = materialize(pii.proposals_of(odd.empty(spark)), "none")
    assert pii.describe(none, pii.fit(none)).count() == 0
