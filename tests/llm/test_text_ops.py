"""Token counts, codec, language ID, quality and SimHash against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from veridrift.llm import langid, piece_codec, piece_model, quality, simhash, token_counts
from veridrift.llm.components import connected_components, least_reached

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b\n c\t\td", "ﬁ é ＡＢ", "<s> x </s><unk>", "\x00a", "日本𠮷 x", "▁a ▁▁b", "   x   y   ", "▁", "ab▁", "é a", "x" * 3000, "word " * 4000]
DOCS = "doc_id long, text string, lang string, fp string, n_tokens int, keys string, key string, component_id int, _place int, _repeat_keys int"


def odd_docs(spark):
    """Odd texts, a null text, null and repeated ids, and columns with the operators' own names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (3, " a"), (3, " a")]
    return spark.createDataFrame([(i, t, None, "x", 1, "k", "k", 7, 1, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_equal_the_library(spark, lib):
    got = sorted(map(tuple, token_counts.count_tokens(odd_docs(spark), MODEL, limit=100).collect()), key=str)
    want = []
    for r in odd_docs(spark).collect():
        t = r.text or ""
        n = len(lib.encode(t))
        want.append((r.doc_id, len(t.encode()), n, n > 100))
    assert got == sorted(want, key=str)


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(odd_docs(spark).limit(0), MODEL).count() == 0


def test_codec_round_trip_and_spans(spark, lib):
    rows = piece_codec.encode(odd_docs(spark), MODEL).collect()
    assert len(rows) == len(ODD) + 4
    for row in rows:
        if row.doc_id is None or row.doc_id == 50:
            continue
        text = ODD[row.doc_id]
        assert row.ids == lib.encode(text)
        assert row.ends == sorted(row.ends) and (not row.ends or row.ends[-1] == len(text.encode()))
        assert row.begins == [0, *row.ends[:-1]][: len(row.begins)]
    decoded = {r.doc_id: r.decoded for r in piece_codec.decode(piece_codec.encode(odd_docs(spark), MODEL), MODEL).collect()}
    assert all(decoded[i] == lib.decode(lib.encode(t)) for i, t in enumerate(ODD))
    assert decoded[50] == ""


def test_chars_map_is_the_longest_prefix_normalization():
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    spec = pb.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    chars = piece_model.CharsMap(spec.normalizer_spec.precompiled_charsmap)
    for text in ["ｶﾞ① ﷺ", "ﬁne ＡＢＣ", "é plain"]:
        norm, source = chars.normalize(text)
        assert norm.decode() == library.normalize(text).replace("▁", " ").lstrip(" ")
        assert len(source) == len(norm) + 1 and source[-1] == len(text.encode()) and source == sorted(source)


def labelled(spark, n=400):
    rng = random.Random(5)
    stems = {"aa": ["mol", "tar", "vik", "sen"], "bb": ["oué", "çai", "leu", "nré"]}
    rows = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(60)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy_and_edges(spark):
    docs = labelled(spark)
    learned = langid.learn(docs)
    assert set(learned) == {"aa", "bb"}
    found = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in found if found[i].held_out]
    assert len(held) > 50 and np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.98
    odd = langid.identify(odd_docs(spark), learned).collect()
    assert len(odd) == len(ODD) + 4 and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 50)} == {"und"}
    assert langid.identify(docs.limit(0), learned).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.learn(odd_docs(spark)) == {}
    kept = langid.keep_identified(docs.unionByName(spark.createDataFrame([(900, "12 34", None), (901, None, None)], docs.schema)), learned)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_held_out_documents_do_not_change_what_is_learned(spark):
    from pyspark.sql import functions as F

    docs = labelled(spark, 200)
    changed = docs.withColumn("text", F.when(langid.held_out("doc_id"), F.lit("zzz")).otherwise(F.col("text")))
    assert langid.learn(docs) == langid.learn(changed)


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = "abracadabra "
    step = langid.suffix_automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            at = step[at].get(c)
            if at is None:
                return False
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(map(accepts, subs))
    assert not any(accepts(s) for s in ("aa", "brb", "cadb", "x"))
    start = langid.linked(step)
    assert langid.phrases(start, "abraxcad") == 3 and langid.phrases(start, "xx") == 2


def naive_phrases(learned, unit):
    n = at = 0
    while at < len(unit):
        size = 1
        while at + size < len(unit) and unit[at : at + size + 1] in learned:
            size += 1
        n, at = n + 1, at + size
    return n


def test_language_equals_naive_longest_matches(spark):
    """Whole texts, across words, against a search for the longest match at each place; ties go to the first name."""
    rng = random.Random(12)
    invented = {k: ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(30)] for k, letters in {"aa": "abcde", "bb": "cdefg", "cc": "abxyz"}.items()}
    rows = [(i, " ".join(rng.choices(invented[k], k=rng.randint(1, 120))), k) for i, k in enumerate(rng.choices(sorted(invented), k=90))]
    rows += [(200 + i, t, None) for i, t in enumerate(ODD)] + [(300, "qqq", None), (301, "½ ²", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs)
    assert set(learned) == set(invented)
    long = " ".join(invented["aa"][i % 30] for i in range(9000))
    whole = langid.learn(spark.createDataFrame([(0, long, "aa"), (0, long, "aa")], "doc_id long, text string, lang string"))
    assert whole == {"aa": langid.letters_of(long)} and len(long) > langid.ROW_CHARS
    got = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    names = sorted(learned)
    twice = langid.Languages({"b": learned["aa"], "a": learned["aa"]})
    for i, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        unit = langid.letters_of(text)
        cost = [naive_phrases(learned[k], unit) * np.log2(len(learned[k]) + 1) for k in names]
        best = cost.index(min(cost))
        assert got[i].lang_pred == names[best]
        rest = min(c for j, c in enumerate(cost) if j != best)
        assert got[i].score == pytest.approx(rest / (rest + cost[best]))
        assert twice.predict(text)[:2] == ("a", 0.5)


def brute_base(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), len(b"".join(words).decode()), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b|", "ü", "d\n", "#"], k=rng.randint(0, 60))) for _ in range(40)] + [*ODD[:-2], None, "x\n\nx\n x \nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, quality.Model()).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        counts = brute_base(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, repr(t)
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r.kept == (not r.base_failed)  # an untrained model keeps what the rules keep


def test_quality_classifier_learns_and_is_calibrated(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["stone", "river", "walks", "under", "light", "seven"], k=40)) + f" end{rng.random()}"
    junk = lambda: " ".join(w + rng.choice(["%%%", "$$$"]) for w in rng.choices(["stone", "river", "walks", "under"], k=40)) + f" end{rng.random()}"
    rows = [(i, junk() if i % 4 == 0 else good()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    held = [r for r in quality.score(docs, model).collect() if r.doc_id >= 400]
    assert all((r.probability >= 0.5) == (r.doc_id % 4 != 0) for r in held)
    assert abs(np.mean([r.probability for r in held]) - 0.75) < 0.05
    assert quality.keep_good(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.learn(docs, labels.limit(0)).key == "" and quality.learn(docs.limit(0), labels).key == ""


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids = [i for i, _ in rows]
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and group[j] > group[i]:
                    group[j], changed = group[i], True
    return {i: min(ids[k] for k in range(len(ids)) if group[k] == g) for i, g in zip(ids, group)}, fps


def near_copies(n=120):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 40])):
            words[rng.randrange(300)] = f"w{rng.randint(0, 9999)}"
        rows.append((1000 - i, " ".join(words)))
    return rows + [(i, t) for i, t in enumerate(ODD[:12])] + [(500_000, None), (500_001, "A b C"), (500_002, "a B c")]


def test_simhash_equals_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, fps = brute_components(rows)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(int(got[i].fingerprint, 16) == f for (i, _), f in zip(rows, fps))
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_simhash_shards_lose_no_pair(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_SIZE", 512)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = fps[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    every = np.unique(np.concatenate([fps, near]))
    forest = simhash._forest(every[::2], len(every), 4)
    assert forest[0].depth > 1
    met = set()
    for tree in forest:
        who, leaf, own = tree.visits(every)
        home = {int(w): int(n) for w, n, o in zip(who, leaf, own) if o}
        assert len(home) == len(every)
        seen = {}
        for w, n in zip(who.tolist(), leaf.tolist()):
            seen.setdefault(n, set()).add(w)
        met |= {(a, b) for b, n in home.items() for a in seen[n]}
    pairs = [(i, j) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 4).tolist() if i != j]
    assert len(pairs) > 900 and all(p in met or p[::-1] in met for p in pairs)


def test_simhash_edges(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and len(ids) == len(set(ids))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_copies(rows, similarity=0.8):
    """The least id reachable through pairs of five-word shingle sets that are as similar."""
    ids, sets = [i for i, _ in rows], [shingle_set(t) for _, t in rows]
    group = {i: i for i in ids}
    for i, a in zip(ids, sets):
        for j, b in zip(ids, sets):
            if a == b or len(a & b) >= similarity * len(a | b) > 0:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def edited(n=200):
    """Texts with scattered edits, replaced passages and changed order, on both sides of the threshold."""
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(rng.randint(60, 400))] for _ in range(15)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        kind = rng.randrange(4)
        if kind == 1:
            for _ in range(rng.randint(1, 8)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
        elif kind == 2:
            at, size = rng.randrange(len(words)), rng.randint(1, 30)
            words[at : at + size] = [f"w{rng.randint(0, 999)}" for _ in range(size)]
        elif kind == 3:
            rng.shuffle(words)
        rows.append((1000 - i, " ".join(words)))
    return rows + [(2000, "A b C"), (2001, "a B c"), (2002, "a B d"), (2003, None), (2004, ""), (2005, " \n"), (2006, rows[0][1].upper())]


def test_near_copies_equal_brute_force(spark):
    rows = edited()
    want = brute_copies(rows)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, node int, n int, f0 int")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == want and 20 < len(set(want.values())) < len(rows) - 50
    kept = simhash.keep_one_copy(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_copies_of_one_base_with_many_own_edits(spark):
    """Copies are alike to the base by 0.87 and to each other by less than 0.8: only the links to the base hold them together."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    rows = [(5000, " ".join(base))]
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(300), 4):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.component_id for r in simhash.near_copies(docs).collect()}
    assert len(found) == 1 and found == {0}


def test_links_across_classes_are_whole():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 30, 20).astype(np.uint64)) for _ in range(90)]
    classes = np.arange(90)
    classes[:6] = 0
    alike = [(i, j) for i in range(90) for j in range(90) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))]
    got = simhash._links_across(sets, sets[6:], classes, classes[6:], 0.6)
    assert all((i, j + 6) in alike for i, j in got)

    def joined(links):
        group = classes.copy()
        for i, j in links:
            group[group == max(group[i], group[j])] = min(group[i], group[j])
        return group.tolist()

    assert joined((i, j + 6) for i, j in got) == joined(alike) and len(set(joined(alike))) < 80


def test_near_copies_edges(spark):
    docs = odd_docs(spark)
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == docs.count()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    ids = [r.doc_id for r in simhash.keep_one_copy(docs).collect()]
    assert None in ids and len(ids) == len(set(ids))
    assert simhash.near_copies(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "p q r s t u v", "x")] * 3 + [(5, "other words", "y")], "doc_id long, text string, text2 string")
    assert [r.component_id for r in simhash.near_copies(one).collect()] == [5] * 4


def test_spanning_forest_is_least_and_spans():
    rng = np.random.default_rng(5)
    for members, edges in ((1, 0), (12, 8), (40, 300), (60, 60)):
        u, v, w = rng.integers(0, members, edges), rng.integers(0, members, edges), rng.integers(0, 6, edges)
        got = simhash.spanning_forest(u, v, w, members)
        group, total, size = list(range(members)), 0, 0
        for k in np.argsort(w, kind="stable"):
            if group[u[k]] != group[v[k]]:
                old, new = group[u[k]], group[v[k]]
                group = [new if g == old else g for g in group]
                total, size = total + w[k], size + 1
        assert len(got) == size and w[got].sum() == total


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_digest_of_ids(spark, lib):
    from veridrift.llm.queries import op4_piece_codec

    rows = {r.doc_id: r for r in op4_piece_codec(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts.items():
        ids = lib.encode(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


@pytest.mark.parametrize("shard", [8, 32])
def test_dealt_leaves_lose_nothing(spark, monkeypatch, shard):
    """With small shards trees have depth, and leaves full of near copies are dealt to parts."""
    monkeypatch.setattr(simhash, "SHARD_SIZE", shard)
    monkeypatch.setattr(simhash, "LEAF_MOST", 2 * shard)
    rng = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            words[at] = f"e{rng.randint(0, 40)}"
        rows.append((5000 + i, " ".join(words)))
    rows += edited(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    copies = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert copies == brute_copies(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)[0]


def test_near_copies_of_deep_trees_meet():
    """Of pairs at a similarity of 0.8 to 0.95 nine in ten at least meet in a leaf of trees with 2,048 leaves each."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(3000)])
    texts = [rng.choice(words, rng.integers(120, 500)) for _ in range(2500)]
    pairs = []
    for k in range(150):
        own, other = texts[k], texts[-1 - k]
        n = int(len(own) * (1 / 0.8 - 1) * 0.97)
        pairs.append((own, np.concatenate([own, other[:n]])))
        edited_words = own.copy()
        at = rng.choice(len(own), max(1, len(own) // 60), replace=False)
        edited_words[at] = rng.choice(words, len(at))
        pairs.append((own, edited_words))
    fps = lambda ts: np.array([simhash.wide_fingerprints(*simhash._shingle_set(" ".join(t), 5))[: simhash.WIDE] for t in ts], np.int64).view(np.uint64)
    sets = [tuple(set(simhash._shingle_set(" ".join(t), 5)[1].tolist()) for t in p) for p in pairs]
    alike = np.array([len(a & b) / len(a | b) >= 0.8 for a, b in sets])
    every, left, right = fps(texts), fps([a for a, _ in pairs]), fps([b for _, b in pairs])
    met = np.zeros(len(pairs), bool)
    for k in range(simhash.WIDE):
        for tree in simhash._forest(np.tile(every[:, k], 4), simhash.SHARD_SIZE << 11, 3):
            assert tree.depth == 11
            home = tree.leaf(left[:, k])
            who, leaf, _ = tree.visits(right[:, k])
            met[who[leaf == home[who]]] = True
    assert alike.sum() > 150 and met[alike].mean() >= 0.9


@pytest.mark.parametrize("radius", [3, 4])
def test_fingerprints_visit_as_many_leaves_in_deep_trees(radius):
    """What is routed grows with the input only: before, each level of the trees asked about 1.4 times as many leaves."""
    fps = np.random.default_rng(3).integers(0, 2**63, 8192, dtype=np.uint64)
    for depth in (4, 10):
        forest = simhash._forest(fps, simhash.SHARD_SIZE << depth, radius)
        assert forest[0].depth == depth
        assert sum(len(tree.visits(fps)[0]) for tree in forest) == len(forest) * len(fps) <= 8 * len(fps)


@pytest.mark.parametrize("guests", [0.0, 0.5])
def test_comparison_by_size_joins_all_close_pairs(guests):
    rng = np.random.default_rng(9)
    shapes = np.repeat(rng.integers(0, 2**63, (60, 2), dtype=np.uint64), 12, 0) ^ (np.uint64(1) << rng.integers(0, 63, (720, 2), dtype=np.uint64))
    sizes, own, ids = rng.integers(0, 60, 720) ** 2, rng.random(720) >= guests, np.arange(720)
    bits = sum(np.bitwise_count(shapes[:, None, k] ^ shapes[None, :, k]).astype(int) for k in range(2))
    close = (bits <= 4) & (np.minimum.outer(sizes, sizes) >= 0.8 * np.maximum.outer(sizes, sizes)) & (own[:, None] | own[None, :]) & (ids[:, None] < ids)
    u, v = simhash.Near(4, 0.8).lightest(own, shapes, sizes, ids, ids)
    assert close[np.minimum(u, v), np.maximum(u, v)].all()
    want, got = (dict(zip(*(x.tolist() for x in least_reached(*e)))) for e in (np.nonzero(close), (u, v)))
    assert want == got and len(want) > 300 and len(set(want.values())) < len(want) - 150


def test_trees_are_shaped_by_fingerprints_of_all_values(spark, monkeypatch):
    """The sample once took the least value of each bucket, so first bits were the same and the last tree had one leaf for most."""
    seen, forest = [], simhash._forest
    monkeypatch.setattr(simhash, "_forest", lambda points, *a: (seen.append(points), forest(points, *a))[1])
    simhash.links(spark.range(6000).selectExpr("xxhash64(id) as fp"), sample_size=128)
    first = (seen[0] >> np.uint64(61)).astype(int)
    assert len(first) == 128 and np.bincount(first, minlength=8).max() < 40
