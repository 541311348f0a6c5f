"""Operators on whole documents, against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import ODD  # noqa: F401  (tests/llm is on the path)
from tradelift.llm import common, exact, mixing, packing, simhash, similar, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, low=0, high=400):
    return " ".join(f"w{rng.randint(low, high)}" for _ in range(n))


# ---------------------------------------------------------------- exact duplicates

def check_groups(rows, found, size):
    norm = lambda t: exact.normalised(t)
    members = defaultdict(list)
    for doc, text in rows:
        members[norm(text)].append(doc)
    want = Counter()
    for doc, text in rows:
        ids = [i for i in members[norm(text)] if i is not None]
        want[doc, max(ids) if ids else None, len(members[norm(text)]), hashlib.sha256(norm(text)).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter({hashlib.sha256(t).hexdigest(): 1 for t in members})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("size", [4, 1024])
def test_exact_groups(frame, size):
    check_groups(ODD, exact.groups(frame(ODD), size).collect(), size)


def test_exact_many_copies_are_dealt_out(frame):
    rows = [(i, "the same block again" if i % 3 else f"other {i}") for i in range(900)]
    check_groups(rows, exact.groups(frame(rows), 8).collect(), 8)


def test_exact_distinct_keeps_columns_and_one_row_each(frame):
    df = frame(ODD)
    out = exact.distinct(df)
    assert out.columns == df.columns
    texts = [exact.normalised(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({exact.normalised(t) for _, t in ODD})
    assert exact.groups(frame([])).count() == 0 and exact.distinct(frame([])).count() == 0


# ---------------------------------------------------------------- near duplicates

def plain_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(values, radius=2):
    top = {v: v for v in values}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= radius:
                top[find(a)] = find(b)
    return {v: find(v) for v in vs}


def test_fingerprints():
    rng = random.Random(3)
    for text in [None, "", "one", "One two", "a b c", words(rng, 900), " A\x0bB\x1cC  d ", "É ß İ x"]:
        assert int.from_bytes(simhash.fingerprint(text), "big") == plain_fingerprint(text)


def test_simhash_classes(frame):
    rng = random.Random(5)
    base = [words(rng, 300) for _ in range(6)]
    rows = [(100 + i, b) for i, b in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [r for r in ODD if r[0] is not None and r[0] != 7] + [(500, "word"), (500, "word"), (None, "apart from all")]
    rows = [(None if i is None else i + 1000 * (t is None), t) for i, t in rows]
    fps = {(i, t): plain_fingerprint(t) for i, t in rows}
    top = plain_components(set(fps.values()))
    least = {}
    for (i, _), v in fps.items():
        if i is not None:
            least[top[v]] = min(i, least.get(top[v], i))
    want = Counter((i, v.to_bytes(8, "big"), least.get(top[v])) for i, t in rows for v in [fps[i, t]])
    assert Counter((r.doc_id, bytes(r.fp), r.component_id) for r in simhash.classes(frame(rows)).collect()) == want
    assert simhash.classes(frame([])).count() == 0


def test_links_of_large_shards_are_all_found(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 150:
        v = rng.choice(sorted(values))
        values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    values |= {rng.getrandbits(64) for _ in range(50)}
    nodes = {v: i for i, v in enumerate(sorted(values))}
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for v, i in nodes.items()], "node bigint, fp binary")
    small = simhash.Scheme(3, 64, 2, simhash.EXACT.tables, simhash.EXACT.finer, shard_size=5)
    def grouped(known):
        sets = common.Groups()
        for r in simhash.links(df, small, known_shards=known).collect():
            sets.join(r.a, r.b)
        return {i: sets.find(i) for i in list(sets.top)}

    found = grouped(simhash.KNOWN_SHARDS)
    assert found == grouped(0)
    top = plain_components(values)
    want = defaultdict(list)
    for v, i in nodes.items():
        want[top[v]].append(i)
    assert {n: c for n, c in found.items()} == {i: min(g) for g in want.values() if len(g) > 1 for i in g}


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10000), 90)
    edges = list(zip(ids[:60], ids[1:60])) + list(zip(ids[60:89], ids[61:90])) + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: min(g) for g in (ids[:60], ids[60:]) for i in g}


def test_components_contract_the_graph(spark):
    """A random chain, a star, a clique and small random groups, contracted to the end, against union-find."""
    rng = random.Random(9)
    chain = rng.sample(range(20_000), 10_000)
    edges = list(zip(chain, chain[1:])) + [(30_000, 30_001 + i) for i in range(500)] + [(i, j) for i in range(31_000, 31_030) for j in range(31_000, i)]
    edges += [(40_000 + rng.randrange(2000), 40_000 + rng.randrange(2000)) for _ in range(900)] + [(7, None), (None, None)]
    rng.shuffle(edges)
    df, rounds = spark.createDataFrame(edges, "a bigint, b bigint"), []
    got = {r.node: r.component for r in common.components(df, at_once=0, rounds=rounds).collect()}
    sets = common.Groups()
    for a, b in edges:
        if a != b and None not in (a, b):
            sets.join(a, b)
    assert got == {n: sets.find(n) for n in list(sets.top)}
    assert len(rounds) <= 20 and all(b < a for a, b in zip(rounds, rounds[1:])), rounds
    assert got == {r.node: r.component for r in common.components(df).collect()}
    assert common.components(df.limit(0)).count() == 0


def test_cut_frames_are_sized_by_their_files(spark):
    df = common.cut(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    for _ in range(30):
        df = common.cut(df.join(df.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("b").alias("b")).union(df.where("a = 999")))
    assert df.count() == 1000 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000


def test_near_copies_leave_one_and_clean_documents_stay(frame):
    rng = random.Random(6)
    clean = [(i, words(rng, 250, 0, 100000)) for i in range(40)]
    near = []
    for k in range(20):
        w = words(rng, 300, 0, 100000).split()
        near.append((100 + 2 * k, " ".join(w)))
        for _ in range(5):  # 5 words changed: similarity of about 0.85 over five-word shingles
            w[rng.randrange(len(w))] = "other"
        near.append((101 + 2 * k, " ".join(w)))
    out = simhash.representatives(frame(clean + near))
    ids = {r.doc_id for r in out.collect()}
    assert {i for i, _ in clean} <= ids and {100 + 2 * k for k in range(20)} <= ids
    assert sum(101 + 2 * k not in ids for k in range(20)) >= 18


def test_stage_of_near_copies_links_by_fingerprint(frame, spark):
    import corpus_pipeline
    rng = random.Random(12)
    rows = []
    for k in range(25):
        w = words(rng, 300, 0, 100000).split()
        for i in range(4):
            rows.append((100 + 4 * k + rng.randrange(4), " ".join(w)))
            w[rng.randrange(len(w))] = "other"
    run = " ".join(f"r{i}" for i in range(5))
    rows += [(3000 + i, (run + " ") * 300 + words(rng, 20, 0, 100000)) for i in range(5)]  # alike in fingerprint, not in their sets of shingles
    rows += [(7, "one"), (7, "an id with two texts"), (8, "an id with two texts"), (9, None), (10, " "), (None, "no id"), (None, "no id"), (11, "same"), (11, "same")]
    fps = [plain_fingerprint(t) for _, t in rows]
    top = plain_components({v for v, (i, _) in zip(fps, rows) if i is not None})
    first = {}
    for i, ((a, _), v) in enumerate(zip(rows, fps)):
        if a is not None:
            first[top[v]] = min(first.get(top[v], (a, i)), (a, i))
    want = Counter([rows[i] for _, i in first.values()] + [r for r in rows if r[0] is None])
    assert 30 < sum(want.values()) < len(rows)
    out = corpus_pipeline.drop_near_copies(spark, frame(rows), "")
    assert out.columns == frame([]).columns and Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert corpus_pipeline.drop_near_copies(spark, frame([]), "").count() == 0


def test_copies_go_without_a_shuffle_of_texts(frame):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"TEXT {i}") for i in range(5)] + [(1000, "text 0"), (None, "text 7"), (None, "alone"), (None, "alone"), (2000, None), (2001, "")]
    out = exact.distinct(frame(rows))
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    best = {}
    for i, t in rows:
        k = (t or "").lower()
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    assert Counter((i, (t or "").lower()) for (i, t), n in kept.items() for _ in range(n)) == Counter((None if i < 0 else i, t) for t, i in best.items())
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rounds", [1, 2])
def test_near_copies_are_those_of_exact_similarity(frame, monkeypatch, rounds):
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar, "FULL", 0 if rounds > 1 else 10)
    rng = random.Random(21)
    run = " ".join(f"r{i}" for i in range(5))
    rows = []
    for i in range(120):  # changed words at a distance give similarities from 0.6 to 1
        w = words(rng, 300, 0, 100000).split()
        rows.append((1000 + 2 * i, " ".join(w)))
        for k in rng.sample(range(0, 300, 5), rng.randint(0, 14)):
            w[k] = "other"
        rows.append((1001 + 2 * i, " ".join(w)))
    base = words(rng, 200, 0, 100000).split()
    for i in range(60):  # a family in which pairs lie on both sides of 0.8
        w = list(base)
        for k in rng.sample(range(200), 3):
            w[k] = f"v{rng.randrange(1000)}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, (run + " ") * 40 + words(rng, 100, 0, 100000)) for i in range(5)]  # a repeated run is one shingle
    rows += [(7, base[0]), (7, "an id with two texts"), (8, "an id with two texts"), (9, None), (10, " "), (None, "no id"), (None, "no id")]
    known = [plain_shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and (known[i] == known[j] or 5 * len(known[i] & known[j]) >= 4 * len(known[i] | known[j])):
                top[find(i)] = find(j)
    first = {}
    for i, (a, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), (a or 0, i)), (a or 0, i))
    want = Counter(rows[i] for _, i in first.values())
    assert Counter((r.doc_id, r.text) for r in simhash.representatives(frame(rows)).collect()) == want
    assert simhash.representatives(frame([])).count() == 0


# ---------------------------------------------------------------- toxicity

def test_toxicity_learns_and_handles_odd_rows(frame, spark):
    rng = random.Random(1)
    bad = ["vile", "nasty scum"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(rng, 60).split()
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w))), labels.append((i, int(toxic), 0.5))
    labels += [(0, None, 0.1), (None, 1, 0.1), (99999, 1, 0.2)]
    label = spark.createDataFrame(labels, "doc_id bigint, toxic int, score double")
    out = toxicity.scored(frame(rows + [(2000, None), (2001, ""), (2002, "vile " * 50000), (None, "fine words"), (5, rows[5][1])]), label).collect()
    assert len(out) == 605 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in list(range(600)) + [2000, 2001, 2002] if zlib.crc32(str(i).encode()) % 4 == 2}
    known = [r for r in held if r.doc_id < 600]
    assert sum((r.doc_id % 4 == 0) == r.predicted for r in known) >= 0.97 * len(known)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r.score)
    assert by[2000] == by[2001] and by[2002][0] >= 0.3 and by[5][0] == by[5][1]


def test_toxicity_without_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.scored(frame([(1, "x"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity.clean(frame([]), none).count() == 0 and toxicity.clean(frame(ODD), none).count() == len(ODD)


def test_toxicity_scores_do_not_depend_on_the_bound(frame, spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(2400):
        toxic = i % 8 == 0
        rows.append((i, "rude" if rng.random() < (0.6 if toxic else 0.1) else "kind")), labels.append((i, int(toxic)))
    docs, label = frame(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    odds = []
    for most in (6000, 300):
        score = {t: r.score for r, t in zip(toxicity.scored(docs, label, max_per_class=most).orderBy("doc_id").collect(), (t for _, t in rows))}
        odds.append(np.array([np.log(score[t] / (1 - score[t])) for t in ("kind", "rude")]))
    # the draw alone, all toxic rows and a fifth of the others, would move the odds by log(5.4) = 1.7
    assert np.abs(odds[1] - odds[0]).max() < 0.8, odds


# ---------------------------------------------------------------- mixing

def plain_raking(cells, targets, keep):
    """Weights by cell, raked in plain Python until nothing moves; a value that runs out gives all its tokens."""
    budget = keep * sum(c[3] for c in cells)
    to = []
    for m, name in enumerate(mixing.MARGINS):
        have = {}
        for c in cells:
            have[c[m]] = have.get(c[m], 0) + c[3]
        raw = targets.get(name) or {v: (n / sum(have.values())) ** mixing.TEMPER[name] for v, n in have.items()}
        got, open_ = {}, set(have)
        while open_:
            level = (budget - sum(got.values())) / sum(raw[v] for v in open_)
            out = {v for v in open_ if raw[v] * level >= have[v]}
            if not out:
                got |= {v: raw[v] * level for v in open_}
                break
            got |= {v: have[v] for v in out}
            open_ -= out
        to.append(got)
    w = {c[:3]: c[3] * keep for c in cells}
    for _ in range(300):
        for m in range(3):
            have = {}
            for c in cells:
                have[c[m]] = have.get(c[m], 0) + w[c[:3]]
            for c in cells:
                w[c[:3]] = min(w[c[:3]] * to[m][c[m]] / have[c[m]], c[3])
    return w


def test_raking_where_a_source_runs_out(spark):
    rng = random.Random(2)
    cells = [(s, l, t, rng.randint(10, 1000)) for s in ["a", "b", None] for l in "xy" for t in "pq"]
    cells = [(*c[:3], c[3] // 8 + 1 if c[0] == "b" else c[3]) for c in cells]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    want = {"source": {"a": 1, "b": 1, None: 1}}
    out, plain = mixing.rake(df, want, keep=0.3).collect(), plain_raking(cells, want, 0.3)
    b = sum(c[3] for c in cells if c[0] == "b")
    assert out[0].gap > 0.05 and abs(sum(r.weight for r in out if r.source == "b") - b) < 1e-2 * b
    assert all(abs(r.weight - plain[r.source, r.lang, r.topic]) < 1e-2 * r.tokens for r in out)


def test_raking_meets_marginals(spark):
    rng = random.Random(2)
    cells = [(s, l, t, rng.randint(400, 1000)) for s in ["a", "b", None] for l in "xy" for t in "pq"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    total = sum(c[3] for c in cells)
    out = mixing.rake(df, {"source": {"a": 1, "b": 1, None: 1}}, keep=0.3).collect()
    w = np.array([r.weight for r in out])
    plain = plain_raking(cells, {"source": {"a": 1, "b": 1, None: 1}}, 0.3)
    assert all(abs(r.weight - plain[r.source, r.lang, r.topic]) < 1e-3 for r in out)
    assert out[0].gap <= 1e-6 and abs(w.sum() - 0.3 * total) < 1e-3 and all(r.weight <= r.tokens for r in out)
    for s in ("a", "b", None):
        assert abs(sum(r.weight for r in out if r.source == s) - 0.1 * total) < 1e-2
    lang = {l: sum(c[3] for c in cells if c[1] == l) ** 0.7 for l in "xy"}
    assert abs(sum(r.weight for r in out if r.lang == "x") / w.sum() - lang["x"] / sum(lang.values())) < 1e-5
    assert mixing.rake(df.limit(0)).count() == 0
    few = mixing.rake(df, {"source": {"a": 1, "z": 5}}).collect()
    assert all((r.weight > 0) == (r.source == "a") for r in few)


@pytest.mark.parametrize("odd", [("new", "x", "p"), (None, "x", "p"), ("a", None, "p"), (None, None, "p")])
def test_a_rare_value_does_not_shrink_the_sample(spark, odd):
    cells = [(s, l, t, n * m) for s, n in (("a", 60), ("b", 25), ("c", 15)) for l, m in (("x", 3000), ("y", 2000)) for t in "pq"]
    schema = "source string, lang string, topic string, tokens bigint"
    plain = mixing.rake(spark.createDataFrame(cells, schema)).collect()
    out = mixing.rake(spark.createDataFrame([*cells, (*odd, 10)], schema)).collect()
    total = sum(c[3] for c in cells)
    assert abs(sum(r.weight for r in plain) - mixing.KEEP * total) < 1 and plain[0].gap <= 1e-5
    assert abs(sum(r.weight for r in out) - mixing.KEEP * total) < 1e-3 * total
    rare = next(r for r in out if r.tokens == 10)
    assert rare.weight > 9.9 and all(r.weight <= r.tokens for r in out) and out[0].gap > 0.5


def test_sample_follows_its_chances(frame):
    rng = random.Random(8)
    rows = [(i, words(rng, 20), rng.choice(["en", "en", "de", None]), rng.choice(["big"] * 6 + ["small", None])) for i in range(3000)]
    out = mixing.sampled(frame(rows)).collect()
    assert len(out) == 3000 and all(0 <= r.chance <= 1.0000001 for r in out)
    for source in ("big", "small", None):
        own = [r for r in out if r.source == source]
        expected, spread = sum(r.chance for r in own), sum(r.chance * (1 - r.chance) for r in own) ** 0.5
        assert abs(sum(r.kept for r in own) - expected) <= 5 * spread + 1
    df = frame(rows)
    assert sorted(r.doc_id for r in mixing.mixed(df).collect()) == sorted(r.doc_id for r in out if r.kept)
    assert mixing.mixed(df).columns == df.columns and mixing.sampled(frame([])).count() == 0
    assert mixing.sampled(frame(ODD)).count() == len(ODD)


# ---------------------------------------------------------------- packing

def fewest(items, limit):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= limit}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_plans_are_sound_and_near_the_fewest():
    rng = random.Random(1)
    more = 0
    for _ in range(200):
        limit = rng.choice([10, 20, 30])
        items = [rng.randint(1, limit) for _ in range(rng.randint(1, 9))]
        fill, used = defaultdict(list), Counter()
        for length, rank, sequence, count, offset in packing.plan(dict(Counter(items)), limit):
            assert rank == used[length]
            used[length] += count
            for i in range(count):
                fill[sequence + i].append((offset, length))
        assert used == Counter(items)
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= limit
        more += len(fill) - fewest(items, limit)
    assert more <= 2


def test_dominating_sets():
    reduced = packing._Plan({9: 2, 6: 1, 4: 1, 3: 3}, 10)
    assert reduced.dominating(9) == [9] and reduced.dominating(6) == [6, 4]
    assert packing._Plan({6: 1, 3: 1, 2: 1}, 10).dominating(6) == [6, 3]


def test_words_encode_like_the_tokenizer():
    from tokenizers import Tokenizer
    text = open(TOKENIZER, encoding="utf-8").read()
    encode, whole = packing._encoder(text), Tokenizer.from_str(text)
    odd = ["", " \t\n", "Don't STOP it's 12km, no. yes... a,b . ,", "<|endoftext|> x<|startoftext|>y", "É é e\u0301 İstanbul ΣΑΣ ß × ÷ ª º ± ½ ²", "a\x1cb \x85 c\xa0d e\u200bf",
           "日本語 テキスト", "a_b __ x'll're 'S 'RE", "<| EndOfText |> <|ENDOFTEXT|>", "x,\ny.\tz."]
    rng = random.Random(0)
    odd += ["".join(rng.choice("aB'.,<|>é É1 \n_-") for _ in range(200)) for _ in range(100)]
    for t in odd:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pack_documents(frame, spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(TOKENIZER)
    parts = packing.pieces(frame(ODD), TOKENIZER, keep_ids=True)
    out = packing.pack(parts).collect()
    by = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 4096 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id].append(r)
    for doc in {i for i, _ in ODD}:
        texts = [t for i, t in ODD if i == doc]
        want = Counter()
        for t in texts:
            ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
            want.update((k, at, tuple(ids[at:at + 4096])) for k, at in enumerate(range(0, len(ids), 4096)))
        assert Counter((r.piece, r.start, tuple(r.ids)) for r in by[doc]) == want
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(frame([]), TOKENIZER)).count() == 0


# ---------------------------------------------------------------- the pipeline

def test_pipeline_against_its_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, at, sf))
        assert out.columns == docs.columns and out.count() <= at.count()
        at = out
    kept = {r.doc_id for r in at.collect()}
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in last} == kept
