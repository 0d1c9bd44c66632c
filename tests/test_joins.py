"""Similarity joins, grouped selection, global positions and the prediction store against brute force; their plans."""

import random
from collections import Counter, OrderedDict, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from veridrift.operators import calibration, numbering, similarity
from veridrift.streaming import monitors, outcome_store


def texts(n, seed, common=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    for i in range(n):
        picked = rng.choices(words[:common], k=rng.randint(0, 4)) + rng.choices(words, k=rng.randint(0, 8))
        rng.shuffle(picked)
        out.append((i, rng.choice([" ", "  ", "\n"]).join(picked) if rng.random() > 0.05 else rng.choice([None, "", "  ", "W1", "w1 W2", "5", "w"])))
    return out + [(n + k, out[k][1]) for k in range(5)]


def word_set(t):
    return set((t or "").lower().split())


@pytest.mark.parametrize("heavy", [similarity.HEAVY, 3])
def test_overlapping_finds_all_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(similarity, "HEAVY", heavy)
    a, b = texts(90, 1), texts(110, 2)
    got = {(r.claim_id, r.source_id): r.overlap for r in similarity.overlapping(spark.createDataFrame(a, "claim_id long, claim_text string"), spark.createDataFrame(b, "source_id long, source_text string"), threshold=0.6).collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            wa, wb = word_set(x), word_set(y)
            if wa and wb and len(wa & wb) / max(len(wa), len(wb)) >= 0.6:
                want[i, j] = round(len(wa & wb) / max(len(wa), len(wb)), 6)
    assert got == want and want


@pytest.mark.parametrize("cell", [similarity.LEAST_CELL, 64])
def test_overlapping_compares_sets_once(spark, monkeypatch, cell):
    for name in ("LEAST_CELL", "CELL"):
        monkeypatch.setattr(similarity, name, cell)
    monkeypatch.setattr(similarity, "TILE", 5)
    rng = random.Random(5)
    base = [[f"v{rng.randint(0, 400)}" for _ in range(n)] for n in (3, 40, 41, 60, 90, 150, 200)]
    said = [" ".join(w if rng.random() > cut else f"x{rng.randint(0, 99)}" for w in ws) for ws in base for cut in (0, 0.1, 0.3, 0.4)]
    said += [said[3]] * 60  # copies
    rows = [(i, i % 3 if i % 10 else None, t) for i, t in enumerate(said)]
    compared = []
    candidates = similarity._candidates
    monkeypatch.setattr(similarity, "_candidates", lambda signed, t: (compared.append(candidates(signed, t)), compared[0])[1])
    a, b = (spark.createDataFrame(rows, f"{side}_id long, k long, {side}_text string") for side in ("claim", "source"))
    sets = [(i, k, word_set(t)) for i, k, t in rows]
    for on in ([], ["k"]):
        compared.clear()
        got = {(r.claim_id, r.source_id): r.overlap for r in similarity.overlapping(a, b, on).collect()}
        want = {(i, j): round(len(x & y) / max(len(x), len(y)), 6) for i, k, x in sets for j, m, y in sets if (not on or k == m is not None) and len(x & y) >= 0.6 * max(len(x), len(y))}
        assert got == want and compared[0].count() < 400  # of 88 * 87 / 2 pairs of texts, 60 of them copies


@pytest.mark.parametrize("heavy", [similarity.HEAVY, 2])
def test_best_source_among_all_sources(spark, monkeypatch, heavy):
    monkeypatch.setattr(similarity, "HEAVY", heavy)
    a = texts(80, 3) + [(500, "w1 w2 w3 w4 w5"), (501, "w1"), (502, "1 w"), (503, "zebra"), (504, "zebra crossing unseen"), (505, None)]
    b = texts(60, 4) + [(700, "x w1 w2 w3 w4 w5 y"), (701, None), (702, "subw13 w9"), (703, "")]
    got = {r.claim_id: (r.source_id, r.similarity, r.status, r.matched_text) for r in similarity.best_source(spark.createDataFrame(a, "claim_id long, claim_text string"), spark.createDataFrame(b, "source_id long, source_text string")).collect()}

    def plain(t):
        return " ".join(t.lower().split())

    for i, x in a:
        best = (None, 0.0, None)
        for j, y in sorted(b):
            if x is None or y is None:
                continue
            like = 1.0 if plain(x) in plain(y) else len(word_set(x) & word_set(y)) / len(word_set(x)) if word_set(x) else 0.0
            if like > best[1]:
                best = (j, like, y[:200])
        if best[1] < 0.5:
            best = (None, 0.0, None)
        status = "verified" if best[1] >= 0.8 else "partial" if best[1] >= 0.5 else "not_found"
        assert got[i] == (best[0], round(best[1], 6), status, best[2]), (i, x)


@pytest.mark.parametrize("few", [similarity.FEW, 0])
def test_claims_are_found_in_tasks_or_by_keys(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "FEW", few)
    written = []
    kept = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: (written.append(df), kept(df))[1])
    a = texts(70, 6) + [(500, "w1 w2 w3 w4 w5"), (501, "w1"), (502, "1 w"), (503, "1 w2 w"), (504, "W1  w1 w1"), (505, None), (506, "")]
    b = texts(60, 7) + [(700, "x w1 w2 w3 w4 w5 y"), (701, None), (702, "subw1 w2 w13"), (703, ""), (704, "w1 w1\tw1")]
    sources = spark.createDataFrame(b, "source_id long, source_text string")
    got = sorted((r.claim_id, r.source_id, r.shared, r.similarity, r.matched_text) for r in similarity.contained(spark.createDataFrame(a, "claim_id long, claim_text string"), sources).collect())
    want = []
    for i, x in a:
        for j, y in b:
            if word_set(x) and word_set(y):
                both = len(word_set(x) & word_set(y))
                like = 1.0 if " ".join(x.lower().split()) in " ".join(y.lower().split()) else both / len(word_set(x))
                want += [(i, j, both, like, y[:200])] if like >= 0.5 else []
    assert got == sorted(want) and bool(written) == (few == 0)  # few claims: no source is written
    assert similarity.contained(spark.createDataFrame([(1, None)], "claim_id long, claim_text string"), sources).count() == 0


def test_few_claims_leave_the_index_unshuffled(spark):
    claims = spark.createDataFrame([(1, "rare words here")], "claim_id long, claim_text string")
    sources = spark.createDataFrame(texts(50, 5), "source_id long, source_text string")
    plan = similarity.overlapping(claims, sources, threshold=0.6)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("few", [calibration._GROUP_FEW, 2])
def test_grouped_selection(spark, monkeypatch, few):
    monkeypatch.setattr(calibration, "_GROUP_FEW", few)
    monkeypatch.setattr(calibration, "_GROUP_BUCKETS", 4)
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(300)] + [("b", float(rng.randint(0, 3))) for _ in range(50)] + [("c", 7.5), ("d", None), (None, 1.0), (None, 2.0)] + [("e", 10.0**k) for k in range(-9, 9)] + [("f", 2.0)] * 9
    got = {r.g: (r.n, r.threshold) for r in calibration.grouped_threshold(spark.createDataFrame(rows, "g string, s double"), "g", "s", 0.9).collect()}
    by = defaultdict(list)
    for g, s in rows:
        if s is not None:
            by[g].append(s)
    assert got == {g: (len(v), sorted(v)[calibration.rank_for(0.9, len(v)) - 1]) for g, v in by.items()}


def test_grouped_selection_sorts_no_group(spark, monkeypatch):
    plans = []
    kept = calibration.stored
    monkeypatch.setattr(calibration, "stored", lambda df: (plans.append(df._jdf.queryExecution().toString()), kept(df))[1])
    calibration.grouped_threshold(spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("s")), "g", "s")
    assert plans and not any("Window" in p for p in plans)


def test_numbers_over_many_ranges_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 2, 3]), rng.choice(["a", "b", None])) for _ in range(400)] + [(1, "same")] * 300
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    out = numbering.numbered(df, ["k"])
    got = sorted(out.collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(len(rows)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert [(r.k, r.t) for r in got] == sorted(rows, key=order)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert numbering.numbered(df.where("false"), ["k"]).count() == 0


def test_cycles_and_zips(spark):
    notes, contexts = spark.createDataFrame([(i,) for i in range(25)], "note long"), spark.createDataFrame([(i * 10,) for i in range(7)], "ctx long")
    assert {(r.note, r.ctx) for r in numbering.cycled(notes, ["note"], contexts, ["ctx"]).collect()} == {(i, i % 7 * 10) for i in range(25)}
    assert {r.ctx for r in numbering.cycled(notes, ["note"], contexts.where("false"), ["ctx"]).collect()} == {None}
    assert {(r.note, r.ctx) for r in numbering.zipped(notes, [F.desc("note")], contexts, ["ctx"]).collect()} == {(24 - i, i * 10) for i in range(7)}
    ids = numbering.sequential_ids(notes, ["note"], "CASE_%03d", "case", start=1).collect()
    assert {(r.note, r.case) for r in ids} == {(i, f"CASE_{i + 1:03d}") for i in range(25)}


def brute_store(rows, capacity):
    held, order, out = defaultdict(OrderedDict), defaultdict(deque), []
    for k, kind, i, lower, upper, outcome, _ in sorted(rows, key=lambda r: r[6]):
        if kind == "prediction":
            held[k][i] = (lower, upper)
            order[k].append(i)
            while len(held[k]) > capacity:
                held[k].pop(order[k].popleft(), None)
        else:
            b = held[k].get(i)
            out.append((k, i, outcome, "ignored" if b is None else "covered" if b[0] <= outcome <= b[1] else "missed"))
    return Counter(out)


def test_prediction_store_over_several_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for n in range(600):
        k, i = rng.choice("abc"), str(rng.randint(max(0, n - 40), n))
        rows.append((k, "prediction" if rng.random() < 0.6 else "outcome", i, 0.0, rng.random(), rng.random(), n))
    shape = "key string, kind string, prediction_id string, lower double, upper double, outcome double, seq long"
    for b in range(4):
        spark.createDataFrame(rows[b * 150 : (b + 1) * 150], shape).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    session = outcome_store.store_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    stream = session.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = monitors.run_once(outcome_store.outcome_answers(stream, "key", ["seq"], capacity=9), f"{tmp_path}/out").collect()
    want = brute_store(rows, 9)
    assert Counter(tuple(r) for r in got) == want
    assert {r[3] for r in want} == {"covered", "missed", "ignored"}
