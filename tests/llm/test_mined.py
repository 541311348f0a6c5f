"""Operators 11 to 13 against brute force and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import ODD  # noqa: F401  (tests/llm is on the path)
from tradelift.llm import collocations, spelling, warc


def plain(rows):
    return sorted(rows, key=repr)


# ---------------------------------------------------------------- collocations

def phrases_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\n-\r]", low):
        yield re.findall("[^ \t]+", piece)


def plain_mined(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for w in phrases_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, p[i:i + m]) for (lang, p), a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[lang, p[i:i + m]]}
    by = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            s, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            by.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])]


@pytest.mark.parametrize("size, places", [(1 << 20, 16), (300, 3), (40, 16)])
def test_collocations_against_brute_force(frame, size, places):
    rng = random.Random(3)
    vocabulary = ["the", "of", "in", "Big", "red", "dog", "é", "ß", "\x1cx", " y", "a", "b"]

    def text():
        out = []
        for _ in range(rng.randrange(30)):
            out.append(rng.choice(["of the", "in the big red dog", rng.choice(vocabulary), rng.choice(vocabulary)]))
            out.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]))
        return "".join(out)

    rows = [(i, text(), rng.choice(["en", "en", "de", None]), "s") for i in range(150)] + [(i, t, "en", "s") for i, t in ODD if len(t or "") < 1000]
    rows += rows[:5] + [(900, "over and over " * 3000, "xx", "s"), (901, "...", "yy", "s"), (902, "one", "zz", "s")]
    got = [tuple(r) for r in collocations.mined(frame(rows), 6, 40, size, places).collect()]
    assert plain(got) == plain(plain_mined([(r[1], r[2]) for r in rows], 6, 40))


def test_collocations_of_an_empty_table(frame):
    assert collocations.mined(frame([(1, "a", "en", "s")]).limit(0)).count() == 0


def test_rare_phrases_are_not_written_out(frame, monkeypatch):
    """Pairs of frequent words are many and mostly rare: counted by hash, only the frequent ones leave a task as words."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(100)) + ". over and over again", "en", "s") for i in range(20)]
    many = len({p for _, t, *_ in rows for w in phrases_of(t) for p in zip(w, w[1:])})
    docs, made = frame(rows).coalesce(2), []
    kind = type(docs)
    plain_map = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda *a, **b: made.append(plain_map(*a, **b)) or made[-1])
    counted = {r.phrase: r.n for r in collocations.phrases(docs, 15)[0].where("words > 1").collect()}
    monkeypatch.undo()
    assert counted == {p: 20 for p in ("over and", "and over", "over again", "over and over", "and over again", "over and over again")}
    assert many > 1500 and sum(m.count() for m in made if "phrase" in m.columns) <= 2 * len(counted)


def test_counts_by_hash_are_packed_and_summed():
    rng = np.random.default_rng(6)
    top, total = (1 << collocations.WIDE) - 1, Counter()
    keys = np.append(rng.integers(0, top, 40), [0, 1, top]).astype(np.uint64)
    packs = []
    for _ in range(5):
        held = [(rng.choice(keys, 30), rng.integers(1, 4, 30)) for _ in range(3)]
        for k, n in held:
            total.update(dict(zip(*[x.tolist() for x in collocations._summed(k, n)])))
        packs.append(collocations._packed(held, 20))
    rows = pa.Table.from_batches(packs).to_pylist()
    parts = {r["part"] for r in rows}
    got = [h for p in parts for h in collocations._frequent(20)(pa.Table.from_pylist([r for r in rows if r["part"] == p], collocations._PACKED))["h"].to_pylist()]
    assert sorted(got) == sorted(k for k, n in total.items() if n >= 20) and 5 < len(got) < len(total)


def test_a_task_sends_words_and_phrases_once_for_all_its_shards(frame, monkeypatch):
    """Every shard has the same frequent phrases: what a task sends for counting grows with their number, not with that of shards."""
    same = ". ".join(f"left{i} right{i} end{i}" for i in range(30))
    rows = [(i, f"{same}. only{i}", "en", "s") for i in range(40)]
    docs, made = frame(rows).coalesce(2), []
    kind = type(docs)
    plain_map = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda *a, **b: made.append(plain_map(*a, **b)) or made[-1])
    counted = {r.phrase: r.n for r in collocations.phrases(docs, 20, 300)[0].collect()}
    monkeypatch.undo()
    assert len(counted) == 30 * 6 and set(counted.values()) == {40}
    index, sent = made[0].cache(), made[-1]
    assert index.count() >= 40 and sent.count() <= 2 * 30 * 3


@pytest.mark.parametrize("kept", [1, 300, 1 << 24])
def test_lists_are_packed_and_summed(kept):
    """Languages apart, counts beyond 32 bits, words of any characters, the same phrase in several batches."""
    rng, names = np.random.default_rng(8), ["a", "a b", "é \x1cx ß", "x" * 5000, "日本 語 a b", "a\u2028b c", '"', "b"]
    total, given = Counter(), []
    for i in range(6):
        some = [str(x) for x in rng.permutation(names)[:rng.integers(0, 8)]]
        n = np.array([(1 << 33) + 1 if x == "b" else 2 for x in some], np.int64)
        lang = ["en", "de"][i % 2]
        total.update({(lang, x): int(k) for x, k in zip(some, n)})
        given.append((lang, pa.array(some, pa.string()), n, collocations._hashed(some, lang)))
    rows = [r for b in collocations._lists(lambda batch: [batch], kept)(given) for r in b.to_pylist()]
    got = [r for p in {r["part"] for r in rows} for r in collocations._often(4, kept)(pa.Table.from_pylist([r for r in rows if r["part"] == p], collocations._LISTS)).to_pylist()]
    assert plain((r["lang"], r["phrase"], r["words"], r["n"]) for r in got) == plain((lang, x, len(x.split(" ")), n) for (lang, x), n in total.items() if n >= 4)
    assert 3 < len(got) < len(total)


def test_a_worker_gathers_phrases_in_pieces(monkeypatch):
    """All phrases of a shard are followed: a worker gets them by some places of its index at a time, and sums, sorts and packs them in slices."""
    monkeypatch.setattr(collocations, "AT_ONCE", 200)
    monkeypatch.setattr(collocations, "SLICE", 100, raising=False)
    rng = random.Random(9)
    rows = [(" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(60))) + rng.choice([". ", "\n", " a a a a a. "]), rng.choice(["en", "de"])) for _ in range(100)]
    docs = pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows], "text": [r[0] for r in rows]})
    index = list(collocations._shards(1 << 20)([docs]))
    want, words = Counter(), Counter()
    for text, lang in rows:
        for w in phrases_of(text):
            words.update((lang, x) for x in w)
            want.update((lang, " ".join(w[i:i + m])) for m in range(2, 5) for i in range(len(w) - m + 1))
    known = type("Sent", (), {"value": [np.full(1, ~np.uint64(0))] * 3})
    found, got, pieces = collocations._several(known, 6), Counter(), []
    for batch in index:
        for lang, names, n, h in found(batch):
            pieces.append(len(n))
            got.update(dict(zip(((lang, x) for x in names.to_pylist()), n.tolist())))
    assert got == want and len(want) > 5000 and max(pieces) <= 100
    hashes = [len(h) for batch in index for *_, h in collocations._followed(batch, known.value, 6)]
    assert max(hashes) <= 200 + max(words.values())
    lists = [b for b in collocations._lists(found, 1 << 24)(index)]
    often = collocations._often(1)
    rows = [r for b in lists for r in b.to_pylist()]
    parts = [r["part"] for r in rows if r["lang"] == "en"]
    assert len(lists) > 20 and len(parts) == len(set(parts)) and max(sum(r["size"] for r in b.to_pylist()) for b in lists) <= 100
    assert {(r["lang"], r["phrase"]): r["n"] for r in often(pa.Table.from_pylist(rows, collocations._LISTS)).to_pylist()} == want


def test_a_row_group_of_the_index_has_one_shard(frame, monkeypatch, tmp_path):
    """Readers and writers of Parquet hold a row group in memory: it does not grow with the shards of a file."""
    made = []
    monkeypatch.setattr(collocations, "shared_path", lambda spark, name: made.append(str(tmp_path / f"{name}{len(made)}")) or made[-1])
    rows = [(i, f"some words of text number {i}. again\nand again", "en", "s") for i in range(40)]
    found = {r.phrase: r.n for r in collocations.phrases(frame(rows).coalesce(2), 40, 100)[0].collect()}
    assert found["some words"] == found["words of text number"] == 40 and found["again"] == 80
    files = [pq.ParquetFile(f).metadata for f in sorted(tmp_path.glob("index0/*.parquet"))]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(files) == 2 and len(groups) > 10 and set(groups) == {1}


def test_the_first_of_a_language_are_found_in_groups(frame, monkeypatch):
    """Ranks by groups of a language and then of what is left equal those of the whole language."""
    monkeypatch.setattr(collocations, "GROUPS", 5, raising=False)
    rng = random.Random(2)
    rows = [(i, ". ".join(f"a{k} b{k}" if rng.random() < 0.9 else f"a{k} c b{k}" for k in range(60)), lang, "s") for i, lang in enumerate(["en"] * 12 + ["de"] * 9)]
    got = collocations.mined(frame(rows), 5, 7)
    assert plain(map(tuple, got.collect())) == plain(plain_mined([(r[1], r[2]) for r in rows], 5, 7))
    assert "pmod(xxhash64(phrase" in got._jdf.queryExecution().optimizedPlan().toString()


def test_index_extends_both_ways():
    rng = np.random.default_rng(5)
    s = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.int32)
    index = collocations.Index(collocations.transform(s, 5), collocations.transform(s[::-1], 5), 5)
    text = s.tolist()
    count = lambda p: sum(text[i:i + len(p)] == p for i in range(len(text)))
    at, phrases = index.words(np.arange(1, 5)), [[w] for w in range(1, 5)]
    for side in ("right", "left", "right"):
        more = index.extended(at, side)
        phrases = [phrases[o] + [w] if side == "right" else [w] + phrases[o] for o, w in zip(more.of, more.word)]
        assert more.n.tolist() == [count(p) for p in phrases] and len({*map(tuple, phrases)}) == len(phrases)
        at = more


# ---------------------------------------------------------------- spelling

def plain_words(rows, length, count):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_grouped(n):
    mates = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in mates.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, k, len(mates[w]), form.get(w), n.get(form.get(w)), root(w)) for w, k in n.items()]


@pytest.mark.parametrize("crowd", [200, 3])
def test_spelling_against_brute_force(frame, crowd):
    rng = random.Random(1)
    roots = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaa", "aaaaaaa", "x" * 300]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i + 1:], w[:i] + rng.choice("abÀ") + w[i:]])

    rows = [(None if i == 7 else i, " ".join(rng.choice([w, w.upper(), w, slip(w), slip(slip(w))]) + rng.choice(["", "9", ",", "€"]) for w in rng.choices(roots, k=60))) for i in range(80)]
    # a third of all words share all but a few letters
    rows += [(1000 + i, " ".join(f"commonprefix{a}{b}ending" for a in "abcdefgh" for b in "abcdefgh")) for i in range(4)] + [r for r in ODD if len(r[1] or "") < 1000] + rows[:3]
    got = spelling.grouped(frame(rows), crowd=crowd).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_grouped(plain_words(rows, 5, 3))
    assert len(want) > 150 and plain(map(tuple, got)) == plain(want)


def test_spelling_of_an_empty_table(frame):
    assert spelling.grouped(frame([(1, "a", "en", "s")]).limit(0)).count() == 0
    assert spelling.grouped(frame([(1, None), (2, "")])).count() == 0


# ---------------------------------------------------------------- WARC

@pytest.mark.parametrize("size", [1 << 24, 900])
def test_archives_round_trip(spark, size):
    rng = random.Random(2)
    big = "<p>" + "same " * 40
    rows = [(i, rng.choice([f"http://a.example/{i}", "https://b.example/x y\t\nz", "http://é.example/", "", None]), rng.choice([big, f"<b>{i}</b>", "", None, "é\r\n\r\nWARC/1.1\r\n\r\n" * 9, f"{i}" * 60 + "\nhttp://x 0.0.0.0 1 t/t 5\n"])) for i in range(200)]
    rows += [rows[3], (None, "http://n.example/", big), (None, None, "é" * 50), (-5, "http://long.example/", "x" * 300_000), (0, "http://dup.example", big)]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id bigint, url string, html string, archive int, type string").repartition(3)
    got = warc.archived(pages, size).collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert plain((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == plain((p, len((h or "").encode()), digest(h)) for p, _, h in rows)
    least = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100:
            least.setdefault(digest(h), []).append(p)
    least = {d: min(ps, key=lambda p: (p is None, p or 0)) for d, ps in least.items()}
    for r in got:
        assert (r.record_type == "revisit") <= (r.payload_bytes >= 100) and (r.refers_to is None or r.refers_to == least[r.payload_digest])
    firsts = Counter(r.payload_digest for r in got if r.record_type == "response" and r.payload_bytes >= 100)
    assert firsts == dict.fromkeys(least, 1) and all(r.page_id == least[r.payload_digest] for r in got if r.record_type == "response" and r.payload_bytes >= 100)
    assert warc.archived(pages.limit(0), size).count() == 0


def test_converted_archives_hold_sound_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", "text " * 30 if i % 3 else f"{i}") for i in range(30)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc", 2000)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    read = warc.read_warc(spark, f"{tmp_path}/warc")
    rows = read.collect()
    assert all(r.sound and r.date == "2024-01-01T00:00:00Z" for r in rows) and len({r.id for r in rows}) == len(rows)
    kinds = Counter(r.type for r in rows)
    assert kinds["warcinfo"] == len({r.archive for r in rows}) > 2 and kinds["response"] == 11 and kinds["revisit"] == 19
    files = [p.read_bytes() for p in (tmp_path / "arc").rglob("*.gz")]
    versions = Counter(next(warc.parse_arc(warc._unzipped(f)))[1][:1] for f in files)
    assert versions[b"1"] and versions[b"2"]
    again = [h for f in (tmp_path / "warc").rglob("*.gz") for h, _ in warc.parse_warc(warc._unzipped(f.read_bytes()))]
    assert plain(h["warc-record-id"] for h in again) == plain(r.id for r in rows)


def test_headers_of_both_versions():
    one = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain 23\n1 0 org\nURL IP-address\nhttp://a/ 1.2.3.4 199901011200 text/html; charset=x 5\nhello\n\ndns:a 1.2.3.4 19990102 text/dns 3\na\nb\n"
    got = [(f["URL"], f["Content-type"], f["Archive-date"], b) for f, b in warc.parse_arc(one)]
    assert got[1:] == [(b"http://a/", b"text/html; charset=x", b"199901011200", b"hello"), (b"dns:a", b"text/dns", b"19990102", b"a\nb")]
    two = b"filedesc://y.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 y.arc 8\n2 0 org\nhttp://a/ 1.2.3.4 20010101000000 text/html 200 abc - 90 y.arc 4\n\n\n\n\n\n"
    assert [b for _, b in warc.parse_arc(two)][1] == b"\n\n\n\n"
    assert [warc._iso(d) for d in (b"19990102", b"1999010213", b"199901021304", b"19990102130405")] == ["1999-01-02T00:00:00Z", "1999-01-02T13:00:00Z", "1999-01-02T13:04:00Z", "1999-01-02T13:04:05Z"]
    for bad in (one[:-5], b"http://a/ 1.2.3.4\n", one.replace(b" 5\n", b" x\n"), one.replace(b"\n1 0 org", b"\n7 0 org")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
