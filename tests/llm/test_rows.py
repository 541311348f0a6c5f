"""Operators on pages, conversations, vectors, lines and licence notices."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import ODD  # noqa: F401
from tools.check import TABLES, compare, rows_of
from tradelift.llm import chat, licenses, lines, queries, topk, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, cur.fetchall())) == "exact"


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in entry.queries()


# ---------------------------------------------------------------- URLs

def plain_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (h == host or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    rules = {(h, p): rng.choice(["block", "allow"]) for h in ("net", "a.net", "x.a.net", "b.net", "ne", "com", "a-b.com", "org") for p in ("/", "/en/", "/en/x", "") if rng.random() < 0.7}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("", "/zz", "block")]
    hosts = ["net", "a.net", "x.a.net", "y.x.a.net", "A.NET", "ba.net", "a-b.com", "b.com", "example.org", "", "net.", "a..net", "é.net"]
    paths = ["", "/", "/en/", "/en/x1", "/enx", "/zz", "?q=/en/", "#://a.net/", "/a\nb"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(600)] + [(600, None), (601, ""), (602, "a.net/en/"), (None, "http://a.net/en/"), (5, "http://net/"), (5, "http://net/"), (603, "x://" + "a." * 3000 + "net/" + "p" * 50000)]
    rows += [(1000 + i, "http://hot.a.net/en/x") for i in range(3000)]
    pages = spark.createDataFrame([(i, u, "<p>", "k", "r") for i, u in rows], "page_id bigint, url string, html string, key string, rule string")
    out = urls.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert Counter(map(tuple, out.collect())) == Counter((i, *plain_verdict(u, rules)) for i, u in rows)
    assert urls.judged(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = urls.judged(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}


# ---------------------------------------------------------------- chat

def test_chat_round_trip(spark):
    rng = random.Random(3)
    hard = ["", None, "\\", "\\\\#", "### user ###\n", "</turn>\n", "<", "\\n", "a\\### Assistant: </turn> ok", "é\U0001f600", "x" * 60000]
    rows = []
    for c in [1, 2, 3, -7, None]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys#tem", None]), rng.choice(hard)))
    rows += [(8, 0, "user", "alone"), (9, None, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, at int, formatted string")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    written = chat.formatted(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in written.select("conv_id", chat.turns(F.col("formatted")).alias("turns")).collect()}
    assert back == {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in want.items()}
    loss = defaultdict(list)
    for e in chat.examples(written).orderBy("conv_id", "n").collect():
        assert e.text.endswith("</turn>\n")
        loss[e.conv_id].append(re.sub(r"\\([shl])", lambda m: {"s": "\\", "h": "#", "l": "<"}[m[1]], e.text[e.loss_start:e.loss_end]))
        n = len(loss[e.conv_id])
        assert e.text.count("</turn>\n") - 1 == [i for i, t in enumerate(sorted(want[e.conv_id])) if t[2] == "assistant"][n - 1]
    assert loss == {c: x for c, v in want.items() if (x := [t[3] for t in sorted(v) if t[2] == "assistant"])}
    digest = {r.conv_id: r for r in chat.digest(df).collect()}
    assert digest[8].loss_chars == 0 and digest[9].loss_chars == 3 and len(digest) == len(want)
    assert chat.digest(df.limit(0)).count() == 0


# ---------------------------------------------------------------- vectors

@pytest.mark.parametrize("block", [4096, 150])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", 5)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 900)]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [float("inf")] + [0.0] * 7), (1003, [None] * 8), (None, [0.1] * 8), (1100, [0.0] * 8), (1200, [1.0, 2.0]), (1201, [2.0, 1.0]), (1300, [])]
    df = spark.createDataFrame([(i, v, 3, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, block int, score double")
    vectors = df.select("vec_id", topk.whole(F.col("embedding")).alias("v"), "block", "score")
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()
    whole = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_reading_rules_out_nearly_all(spark):
    """Of the candidates of a block few are scored after reading; large and repeated components give the same as plain products."""
    v = np.array([r.v for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", topk.whole(F.col("embedding")).alias("v")).where("v is not null").orderBy("vec_id").collect()])
    lists, own = topk.Lists(np.arange(len(v)), v), np.arange(0, len(v), 25)
    for bar in (None, np.array([np.sort(np.delete(v @ v[i], i))[-10] for i in own])):
        lists.asked = lists.scored = 0
        for i, (ids, score) in zip(own, lists.best(own, v[own], 10, bar)):
            want = sorted((-int(x), j) for j, x in enumerate(v @ v[i]) if j != i)[:10]
            assert [(-int(s), int(j)) for j, s in zip(ids, score)] == want
        assert lists.asked == len(own) * (len(v) - 1) and lists.scored <= 0.05 * lists.asked, (lists.scored, lists.asked)
    rng = np.random.default_rng(2)
    big = rng.integers(-3, 4, (500, 6)) * 10 ** 8 + rng.integers(-1, 2, (500, 6))
    lists = topk.Lists(np.arange(500), big)
    for i, (ids, score) in zip(range(50), lists.best(np.arange(50), big[:50], 10)):
        exact = big.astype(object) @ big[i].astype(object)
        assert list(zip(score.tolist(), ids.tolist())) == [(-s, j) for s, j in sorted((-int(x), j) for j, x in enumerate(exact) if j != i)[:10]]
    with pytest.raises(OverflowError):
        topk.Lists(np.arange(3), np.full((3, 4), 1 << 40)).best(np.array([9]), np.full((1, 4), 1 << 40), 2)


# ---------------------------------------------------------------- lines

def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(1000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "ab")
        most, true = rng.randint(0, 14), edit(a, b)
        got = lines.distance(a, b, most)
        assert got == true if true <= most else got > most


def test_simhashes_of_lines():
    import xxhash
    rng = random.Random(1)
    texts = [[f"w{rng.randint(0, 50)}".encode() for _ in range(n)] for n in (0, 1, 2, 30, 254, 255, 256, 600, 0, 3)]
    for words, got in zip(texts, lines.simhashes(texts)):
        h = [xxhash.xxh64_intdigest(w) for w in words]
        mask = (1 << 64) - 1
        h += [(((a * 0x9E3779B97F4A7C15 + b) & mask) * 0xC2B2AE3D27D4EB4F) & mask for a, b in zip(h, h[1:])]
        assert int(got) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_lines_against_brute_force(frame):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randint(0, 500):03d}x{chr(97 + rng.randrange(26)) * 3}" for _ in range(25)) for _ in range(30)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(25)] += rng.choice("abc")
            own.append(rng.choice([" ".join(w), " ".join(w).upper() + "!", "", "  "]))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "x" * 100000 + "\n" + "y " * 20000), (None, base[0]), (103, base[1] + "\n" + base[1])]
    texts = [(i, n, lines.normal(x).decode()) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")) if lines.normal(x)]
    known = sorted({t for *_, t in texts})
    sims = lines.simhashes([k.encode().split() for k in known])
    top = list(range(len(known)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            if int(sims[i] ^ sims[j]).bit_count() <= 3 and len(known[i]) < 5000 and 1 - edit(known[i], known[j]) / max(len(known[i]), len(known[j])) >= 0.8:
                top[find(i)] = find(j)
    first = {}
    for i, n, t in sorted(texts):
        first.setdefault(find(known.index(t)), (i, n))
    want = {(i, n): first[find(known.index(t))] == (i, n) for i, n, t in texts}
    df = frame(rows)
    got = lines.marked(df).collect()
    assert {(r.doc_id, r.line): r.kept for r in got} == want and len(got) == len(want)
    out = lines.deduplicated(df)
    assert out.columns == df.columns
    texts_out = {r.doc_id: r.text for r in out.collect()}
    for i, t in rows:
        assert texts_out[i] == (t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((i, n), True)))
    assert lines.decided(frame([])).count() == 0


def test_rows_of_small_and_large_keys_meet():
    rng = random.Random(5)
    rows = []
    for k in range(400):
        key = (k % 10) << 26 | k
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3, lines.SMALL, lines.SMALL + 1, 300 if k % 40 == 0 else 4])):
            sim = base if rng.random() < 0.5 else rng.getrandbits(64)
            for _ in range(rng.randrange(5)):
                sim ^= 1 << rng.randrange(64)
            rows.append((key, len(rows), sim))
    rows.sort(key=lambda r: r[0])
    want = set()
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        want |= {(key, a[1]) for a in group for b in group if a[1] != b[1] and lines._owned(np.uint64(a[2]), np.uint64(b[2]), key)}
    columns = [np.array(c, np.uint64).view(np.int64) for c in zip(*rows)]
    for step in (1, 7, 1000, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i:i + step]) for c in columns], ["key", "id", "sim"]) for i in range(0, len(rows), step)]
        got = [x for b in lines._near(iter(batches)) for x in zip(*b.to_pydict().values())]
        assert len(got) == len(want) and set(got) == want
    assert want and not list(lines._near(iter([])))


def test_plain_edits_need_no_distance(monkeypatch):
    rng = random.Random(3)
    pairs = []
    for _ in range(3000):
        a = [rng.choice(["ab", "abc", "é", "xyz", "longer"]) for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randint(0, 1)] = [rng.choice(["ab", "abd", "o"])] * rng.randint(0, 1)
        pairs.append((" ".join(a), " ".join(b)))
    for a, b in pairs:
        longer = max(len(a), len(b))
        assert lines._similar(a, b) == (lines.distance(a, b, longer) <= int(0.2 * longer + 1e-9))
    monkeypatch.delattr(lines, "distance")
    w = [f"word{i}" for i in range(20)]
    assert all(lines._similar(" ".join(w), " ".join(x)) for x in (w[:9] + w[10:], w[:9] + ["new"] + w[9:], w[:2] + ["b"] + w[3:15] + ["c"] + w[16:]))


def test_lines_of_an_id_with_two_texts(frame):
    line = " ".join(f"word{i}" for i in range(25))
    rows = [(1, f"first alone\n{line}\nlast alone"), (1, "short"), (1, f"{line}\nother line"), (2, line + "\nsecond alone"), (3, "short\nmore")]
    got = sorted((r.doc_id, r.text) for r in lines.deduplicated(frame(rows)).collect())
    assert got == sorted([(1, "first alone\nlast alone"), (1, "short"), (1, f"{line}\nother line"), (2, "second alone"), (3, "more")])
    near = [(1, "one\ntwo\n" + line), (1, "short"), (2, line + "x")]
    assert sorted((r.doc_id, r.line) for r in lines.marked(frame(near)).collect()) == [(1, 0), (1, 0), (1, 1), (1, 2), (2, 0)]


# ---------------------------------------------------------------- licences

def test_licenses_against_brute_force(frame):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    rows = []
    for i in range(60):
        name, text = rng.choice(list(licenses.TEMPLATES.items()))
        w = text.split()
        if rng.random() < 0.3 and len(w) > 20:
            w[rng.randrange(len(w))] = "altered"
        rows.append((i, f"{filler(rng.randint(0, 60))}\n{' '.join(w)} {filler(rng.randint(0, 60))}"))
    rows += [(100, None), (101, ""), (102, "Licensed under"), (103, filler(40000)), (None, "released UNDER the mit license"), (104, "Released under the MIT License.\n" * 50)]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    five = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = {}
    for i, t in rows:
        w = split(t)
        for name, text in licenses.TEMPLATES.items():
            tw = split(text)
            step, goal = max(1, len(tw) // 4), five(tw)
            if goal & five(w):
                best = max(len(goal & five(w[max(0, a - step):a + len(tw) + step])) / len(goal) for a in range(0, len(w), step))
                if best >= 0.8:
                    want[i, name] = best
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(frame(rows)).collect()}
    assert got == pytest.approx(want)
    assert licenses.scan(frame([])).count() == 0 and licenses.scan(frame(rows), {}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(frame(rows), {"short": "two words"})
