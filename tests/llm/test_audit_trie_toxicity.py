"""Filter audit, prefix trie and toxicity against brute force, their SQL and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from test_queries import comparable

from veridrift.llm import filter_audit, prefix_trie, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, mask int, cls string"
LABELS = "doc_id long, quality int, toxic int, n string"


def audit_rows(seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "d#", "E", f"w{k}"]) for k in range(n)) for n in (0, 1, 10, 49, 50, 60, 200, 900)]
    base += [base[-1][:-1] + "x", base[-1][:5000] + "y" + base[-1][5001:], "ÄÖ " * 60, " \t\n", "A" * 30]
    rows = [(i, rng.choice(base), "en", rng.choice(["a", "b", "", None]), 1, "x") for i in range(80)]
    rows += [(None, base[5], None, "a", 1, None), (None, base[5], None, "a", 1, None), (90, None, None, "a", 2, "y"), (91, "", None, "c", 2, "y")]
    return rows + [rows[7], rows[7], (7, base[6], "en", "b", 0, ""), (-4, base[6], "en", "b", 0, "")]


def brute_audit(rows, labels):
    good, bad = {i for i, q, _, _ in labels if q == 1}, {i for i, _, t, _ in labels if t == 1}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = defaultdict(list)
    for i, t, _, part, *_ in rows:
        t = t or ""
        ws = [w for w in t.encode().split() if w]
        fails = {"A"[: len(ws) < 50], "B"[: 100 * len(set(ws)) < 65 * len(ws)], "C"[: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)], "D"[: any(c in "#$%&*|" for c in t)], "E"[: i is not None and least[t] < i]} - {""}
        masks[part or ""].append((fails, i is not None and i in good, i is not None and i in bad))
    out = set()
    for part, docs in masks.items():
        removed_at, orders = Counter(), ["".join(o) for o in permutations("ABCDE")]
        for o in orders:
            for s, f in enumerate(o):
                removed_at[f] += sum(f in m and not m & set(o[:s]) for m, _, _ in docs)
        for o in orders:
            for s, f in enumerate(o):
                gone, before = [(m, g, b) for m, g, b in docs if f in m and not m & set(o[:s])], [m for m, _, _ in docs if f in m and m & set(o[:s])]
                kept = sum(not m & set(o[: s + 1]) for m, _, _ in docs)
                out.add((part, o, s + 1, kept, len(gone), len(before), sum(m == {f} for m, _, _ in docs), sum(g for _, g, _ in gone), sum(b for _, _, b in gone), removed_at[f]))
    return out


def test_audit_equals_brute_force_and_sql(spark, tmp_path):
    rows, labels = audit_rows(), [(i, i % 2, i % 3 == 0, None) for i in range(0, 60, 2)] + [(None, 1, 1, None), (4, 1, 1, None), (6, None, None, "x"), (12, 0, 0, None)]
    labels = [(i, q, None if t is None else int(t), n) for i, q, t, n in labels]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.op11_filter_audit(spark, str(tmp_path))
    got = df.collect()
    assert {tuple(r) for r in got} == brute_audit(rows, labels) and len(got) == 600 * len({r[3] or "" for r in rows})
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cursor = con.execute(queries.oracle_sql()["op11_filter_audit"])
    assert comparable(got, df.columns) == comparable(cursor.fetchall(), [c[0] for c in cursor.description])


def test_audit_of_an_empty_table(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_duplicates_split_by_later_blocks(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCKS", [(0, 4), (4, 8), (12, 2**31 - 20)])
    texts = ["abcdefghijklmnop", "abcdefghijklmnoq", "abcdXfghijklmnop", "abcdefghijklmnop", "abc", "abd", "abc", "", None, "abcdefghijklmnop"]
    df = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in filter_audit.duplicates(df).collect()} == {10, 7, 6, 3}
    # one slot for every class: texts of other classes are compared too and change nothing
    monkeypatch.setattr(filter_audit, "SLOT_WORDS", 1)
    assert {r.doc_id for r in filter_audit.duplicates(df).collect()} == {10, 7, 6, 3}


CONVS = "conv_id long, turn long, role string, text string, key string, path int"


def conversations(seed=5, n=260):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 1000, 1001, 1234567, -3, -100]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, 0]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "ä long text", "", None, "b", "b"]), "k", 1))
    rows += [(5, None, "user", "first", None, 0), (None, 0, "user", "nobody", None, 0)] + [(2, 7, "user", "again", None, 0)] * 3
    rng.shuffle(rows)
    return rows


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + path[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        return [p] + [x for k in kids[p] for x in below(k)]

    out = set()
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].decode()) if x else 0) for x in sub)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


@pytest.mark.parametrize("most", [50_000, 40, 1])
def test_trie_equals_brute_force(spark, most):
    rows = conversations()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVS), max_turns=most).collect()
    want, n = brute_trie(rows)
    assert {tuple(r) for r in got} == want and len(got) == n


def test_trie_of_long_shared_beginnings_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 12)
    rows = [(c, t, "user", f"t{t}" if t < 30 + c % 3 else f"own {c} {t}", None, 0) for c in range(10) for t in range(32 + c % 2)]
    rows += [(c, t, "user", f"same {t}", None, 0) for c in range(2000, 2060) for t in range(8)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVS), max_turns=20).collect()
    want, n = brute_trie(rows)
    assert {tuple(r) for r in got} == want and len(got) == n


def test_trie_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(conversations(8, 120), CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op12_prefix_trie(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(queries.oracle_sql()["op12_prefix_trie"])
    assert comparable(df.collect(), df.columns) == comparable(cursor.fetchall(), [c[0] for c in cursor.description])


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "lost", None, 0)], CONVS)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def toxic_rows(n=900, seed=2):
    rng = random.Random(seed)
    plain = {"en": [f"en{k}" for k in range(300)], "de": [f"de{k}" for k in range(300)]}
    bad = {"en": ["idiot", "scum", "moron"], "de": [f"lowei{x}" for x in ("a", "en", "haft", "ung", "keit", "los")]}
    rows, labels = [], []
    for i in range(n):
        lang, toxic = rng.choice(["en", "de"]), rng.random() < 0.3
        words = rng.choices(plain[lang], k=rng.randint(5, 120))
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(bad[lang])
        rows.append((i, " ".join(words), lang, None, 0, ""))
        labels.append((i, 1, int(toxic), None))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows + [(None, "scum", None, None, 0, ""), (5000, None, "en", None, 0, ""), (5001, "", None, None, 0, ""), rows[0]], DOCS)
    lies = [(i, q, 1 - t, n) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t, n) for i, q, t, n in labels]  # labels that must not be learned from
    model = toxicity.learn(docs, spark.createDataFrame(lies + [(None, 1, 1, None), (3, 1, None, None)], LABELS))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t, _ in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in [*truth, 5000, 5001] if zlib.crc32(str(i).encode()) % 3 == 1}
    known = [r for r in held if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001))
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """Each of 700 words marks six toxic documents, so a sample of documents knows too few of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    plain, bad = [word() for _ in range(300)], [word() for _ in range(700)]
    rows, labels = [], []
    for i in range(8400):
        words, toxic = rng.choices(plain, k=10), i % 2
        if toxic:
            words[rng.randrange(10)] = bad[i // 2 % 700]
        rows.append((i, " ".join(words), "en", None, 0, ""))
        labels.append((i, 1, toxic, None))
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 150_000, raising=False)
    docs = spark.createDataFrame(rows, DOCS)
    got = [r for r in toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame(labels, LABELS))).collect() if r.held_out]
    assert np.mean([r.predicted for r in got if r.doc_id % 2]) > 0.9
    assert np.mean([r.predicted for r in got if not r.doc_id % 2]) < 0.05


def test_toxicity_sums_and_averages_over_shards(spark):
    rows, labels = toxic_rows(300, 4)
    examples = spark.createDataFrame([(i % 5, label, lang, text) for (i, text, lang, *_), (_, _, label, _) in zip(rows, labels)], "shard long, label int, lang string, text string")
    count = lambda batches: toxicity._sent({f"{label} {lang}": c for (label, lang), c in toxicity._counts(toxicity._read(batches)).items()})
    whole = toxicity._counts([([toxicity.split_words(r[1]) for r in rows], [x[2] for x in labels], [r[2] for r in rows])])
    got = toxicity._totals(examples.repartition(3), count)
    assert {k: c.tolist() for k, c in got.items()} == {f"{label} {lang}": c.tolist() for (label, lang), c in whole.items()}
    state = toxicity._Fit(toxicity._begun(whole))
    before, sums = state.model.table[:3].copy(), {}
    for shard in range(4):  # all move vector 0, one moves vector 1, none vector 2; the filters follow the documents
        own = state.copy()
        own.model.table[:3] += shard
        own.model.bias += shard
        own.touched[0], own.touched[1], own.docs = 1, shard == 3, 1 + 2 * (shard == 3)
        toxicity._add(sums, own.weighted())
    state.averaged(sums)
    assert state.model.table[:3] - before == pytest.approx(np.repeat([[1.5], [3], [0]], toxicity.DIM, axis=1), abs=1e-5)
    assert state.model.bias == pytest.approx(np.full(len(state.model.bias), 2.0))


def test_toxicity_reads_whole_texts_in_spans(spark, monkeypatch):
    rows, labels = toxic_rows(500, 6)
    model = toxicity.fitted([toxicity.split_words(r[1]) for r in rows], np.array([x[2] for x in labels], float), [r[2] for r in rows], 0.3)
    text = " ".join(["en1 en2 en3"] * 40 + ["scum idiot moron"])
    whole = toxicity._score(model, text)
    assert whole > toxicity.MARK > toxicity._score(model, " ".join(["en1 en2 en3"] * 40))
    monkeypatch.setattr(toxicity, "SPAN", 7)
    assert toxicity._score(model, text) == pytest.approx(whole, abs=1e-5)


def test_toxicity_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame(toxic_rows(20)[0], DOCS), spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1, None)], LABELS)
    assert {r.predicted for r in toxicity.score(docs, toxicity.learn(docs, one)).collect()} == {0}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.learn(empty, one)).count() == 0


def test_subword_features_do_not_depend_on_neighbours():
    alone = [toxicity.subwords([w]) for w in (b"scum", b"a", b"!!", b"loweikeit")]
    codes, begins = toxicity.subwords([b"scum", b"a", b"!!", b"loweikeit"])
    ends = [*begins[1:], len(codes)]
    assert all(sorted(codes[b:e]) == sorted(own) for (own, _), b, e in zip(alone, begins, ends))
