"""Operators on small tables: against brute force, round trips and held-out labels, with nulls, ties, empty tables and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tests.compare import connection, difference
from tidemark.llm import byte_bpe, chunked_bpe, common, components, decontamination, fertility, gru_langid, queries, sharding, simhash, site_quality, style_tree, token_counts, warc

SF = "/root/testdata/sf0.001"
VOCABULARY = common.tokenizer_path("byte_bpe_50k.json")
PIECES = common.tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = DOCS + ", fp long, slot long, fingerprint string, salt int, kept string, host string, m string, l string, out string, h long"


def documents():
    return connection(SF).execute("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, equal rows, columns with names that operators use inside."""
    words = " ".join(random.Random(3).choice(["the", "and", "house", "tree", "rain"]) for _ in range(40_000))
    rows = [(1, "one two three four five " * 20, "en", "a", 5), (1, "one two three four five " * 20, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "fr", "b", 4), (5, words, "en", "a", 9), (6, "\U0001f600 <|endoftext|> é", None, "b", 3), (None, "no id here", "en", None, None), (None, None, None, None, None), (7, "123 456 --", "de", "b", 1), (8, "one two three four five " * 20, "en", "a", 5)]
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z", "m", "l", "o", 4) for r in rows], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


HARD = ["", "   ", "a<|endoftext|>b <|endoftext|>", "  \n\n x  " * 300, "a" * 5000, "日本語テスト " * 300, "౜್abc é" * 100, "don't we'll I'M " * 200, " " * 3000 + "x", "😀👍🏽 " * 200, "x   y\x1c\x1d z  q"]


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice(" \n\t'aAbsz1é日,.!<|>") for _ in range(rng.choice([5, 50, 3000]))) for _ in range(80)] + [r[1] for r in documents()]
    enc, bpe = chunked_bpe.ChunkEncoder(VOCABULARY, kept_bytes=100_000), byte_bpe.load(VOCABULARY)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.n_tokens(text) == len(ids)
        assert enc.ids(text) == ids
        n, a, b = enc.digest(text)
        assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert enc.hits and enc.held <= 100_000


CONTRACTED = ["you're", "we've", "they'll", "I'd", "it's", "don't", "the", "house", "'re", "l'été", "d'où", "qu'ils", "rock'n'roll", "x", "--", "!'ve", "'", "''", " ", "\n", "12'll", "é"]


def test_kept_pieces_are_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chunked_bpe, "KEPT_TEXTS", 100)
    monkeypatch.setattr(byte_bpe, "_loaded", {})
    enc, text = chunked_bpe.ChunkEncoder(VOCABULARY), " ".join(f"w{k}x{k * k}" for k in range(2000))
    assert enc.ids(text) == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert len(enc.bpe.texts) <= 100 and len(enc.bpe.texts.old) <= 100


def test_contractions_cut_at_every_byte():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    text = "You're here, we've  been; they'll say I'd go -- it's \"'re\" l'été d'où qu'ils !'ve 12'll\n\n  x's 'tis o'clock's  don't " * 2
    want, data = library.encode(text, add_special_tokens=False).ids, text.encode()
    starts = [k for k in range(1, len(data)) if data[k] & 0xC0 != 0x80]
    ends = [[k, len(data)] for k in starts] + [[k for k in starts if k % step == off] + [len(data)] for step in (9, 13, 17, 31, 40) for off in range(step)]
    for at in ends:
        enc = chunked_bpe.ChunkEncoder(VOCABULARY)
        enc.cuts = lambda d, at=at: at
        assert enc.ids(text) == want
    rng, enc = random.Random(8), chunked_bpe.ChunkEncoder(VOCABULARY)
    for _ in range(300):
        text = " ".join(rng.choice(CONTRACTED) for _ in range(1500))
        assert enc.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_own_merges_equal_library_merges():
    bpe = byte_bpe.load(VOCABULARY)
    for text in HARD[3:9]:
        for piece in set(bpe.split.findall(text)):
            assert bpe.ids(piece) == bpe.library_ids(piece)


def test_shared_passages_are_cut_alike():
    passage = " ".join(f"word{i}" for i in range(3000))
    a, b = (("short start " + passage).encode(), ("a different and longer start than that: " * 9 + passage).encode())
    ends = lambda d: {bytes(d[max(0, e - 40) : e]) for e in chunked_bpe.cuts(d)}
    assert len(ends(a) & ends(b)) > 0.7 * len(ends(a))


def test_token_counts(spark, odd, empty):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd, VOCABULARY).collect()}
    assert got[2, 0] == (0, False) and got[3, 0] == (0, False)
    assert next(v for k, v in got.items() if k[0] == 5)[1] is True
    assert token_counts.token_counts(empty, VOCABULARY).count() == 0


def test_round_trip(odd, empty):
    rows = chunked_bpe.round_trip(odd, VOCABULARY).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, nothing, nothing)}
    assert len(rows) == 11 and chunked_bpe.round_trip(empty, VOCABULARY).count() == 0
    assert chunked_bpe.encode(odd, VOCABULARY).count() == 11


def test_sharding(spark, odd, empty):
    docs = common.table(spark, SF, "documents").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = sharding.shard(docs, [1.0] * 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
        assert r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == docs.count()
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] > 8}
    for r in rows:
        if r["doc_id"] in texts:
            data = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert sharding.shard(odd, [1.0] * 8).count() == 11 and sharding.shard(empty, [1.0] * 8).count() == 0


def test_shards_equal_brute_force(spark):
    """Scores from the hash itself: 52 bits of XXH64 of the key, then of the shard's name seeded with it."""
    weights, grown = [1.0, 2.0, 0.5], [1.0, 2.0, 0.5, 1.5]

    def best(key: str, w: list[float]) -> int:
        first = xxhash.xxh64_intdigest(key.encode(), 42)
        draw = [((xxhash.xxh64_intdigest(f"shard {i}".encode(), first) >> 12) + 0.5) / 2**52 for i in range(len(w))]
        return min(range(len(w)), key=lambda i: (-np.log(draw[i]) / w[i], i))

    rows = sharding.shard(common.table(spark, SF, "documents"), weights, grown).collect()
    assert all((r["shard"], r["grown_shard"]) == (best(str(r["doc_id"]), weights), best(str(r["doc_id"]), grown)) for r in rows) and len(rows) == 200


def test_copies_of_a_row_are_spread_over_buckets(spark):
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard(docs, [1.0] * 8)
    assert sorted(r["slot"] for r in rows.collect()) == list(range(20_000))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    r = keys.select(sharding.rendezvous(F.col("k"), [1.0, 2.0, 1.0, 0.0]).alias("a"), sharding.rendezvous(F.col("k"), [1.0, 2.0, 1.0, 0.0, 1.0]).alias("b"))
    n = {(x["a"], x["b"]): x["count"] for x in r.groupBy("a", "b").count().collect()}
    share = lambda a: sum(v for k, v in n.items() if k[0] == a) / 20_000
    assert abs(share(1) - 0.5) < 0.02 and share(3) == 0
    assert all(a == b or b == 4 for a, b in n)


PAGES = "page_id long, url string, html string, payload_digest string, refers_to long, block string, value string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, "http://a/1", "same"), (1, "http://a/1", "same"), (2, None, None), (5, "http://b", ""), (None, "u", "same"), (7, "http://c", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (8, "http://d", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "d", 1, "b", "v") for r in rows], PAGES)
    warc.write_warc(pages, f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert not [r for r in got if r["kind"] == "gap"] and len(got) == 8
    types = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert types[1, "response", None] == 2 and types[3, "revisit", 1] == 1 and types[None, "revisit", 1] == 1 and types[5, "revisit", 2] == 1
    for r in got:
        if r["page_id"] == 3:
            assert (r["payload_bytes"], r["payload_digest"]) == (4, warc.sha1_32(b"same"))
        if r["page_id"] == 8:
            assert bytes(r["payload"]).decode() == "é" * 70_000
    warc.write_warc(spark.createDataFrame([], PAGES), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0
    assert difference(spark, SF, warc.query, warc.SQL) == ""


def record(n: int, body: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (n, warc.sha1_32(block).encode(), len(block)) + block + b"\r\n\r\n"


def test_salvage():
    rng = random.Random(2)
    parts = [record(n, bytes(rng.choice(b"ab<>\r\n W") for _ in range(200))) for n in range(30)]
    data = b"".join(parts)
    starts = np.cumsum([0] + [len(p) for p in parts])
    for _ in range(60):
        hurt = bytearray(data)
        at = rng.randrange(len(data))
        if rng.random() < 0.5:
            hurt[at] ^= 0x41
        else:
            del hurt[at : at + rng.randrange(1, 400)]
        out = list(warc.salvage(bytes(hurt)))
        assert sum(x[2] for x in out) == len(hurt) and all(a[1] + a[2] == b[1] for a, b in zip(out, out[1:]))
        ids = [int(x[3].get("x-page-id", "99")) for x in out if x[0] == "record" and x[3].get("x-page-id", "99").isdigit()]
        hit = np.searchsorted(starts, at, "right") - 1
        assert set(range(30)) - set(ids) <= {int(hit) - 1, int(hit), int(hit) + 1, int(hit) + 2}
    members = [gzip.compress(p) for p in parts]
    hurt = bytearray(b"".join(members))
    at = sum(map(len, members[:10])) + len(members[10]) // 2
    hurt[at] ^= 0xFF
    out = list(warc.salvage(bytes(hurt)))
    assert [int(x[3]["x-page-id"]) for x in out if x[0] == "record"] == [n for n in range(30) if n != 10]
    assert [x[2] for x in out if x[0] == "gap"] == [len(members[10])]


def test_salvage_of_gzip_archives_with_damaged_starts():
    rng = random.Random(4)
    parts = [record(n, rng.randbytes(200)) for n in range(30)]
    data = b"".join(gzip.compress(b"".join(parts[k : k + 3])) for k in range(0, 30, 3))
    ids = lambda data: [int(x[3]["x-page-id"]) for x in warc.salvage(data) if x[0] == "record"]
    assert ids(data) == list(range(30))
    assert ids(b"\0" + data[1:]) == list(range(3, 30)) and ids(b"junk" + data) == list(range(30))
    # the first record of a member stays if the last is damaged
    size = len(gzip.compress(b"".join(parts[:3])))
    hurt = bytearray(data)
    hurt[size - 100] ^= 0xFF
    out = list(warc.salvage(bytes(hurt)))
    assert ids(bytes(hurt)) == [0, 1, *range(3, 30)] and [x[1:3] for x in out if x[0] == "gap"] == [(0, size)]
    assert ids(parts[0] + data[:-9] + parts[1]) == [0, *range(30), 1]


def test_no_bytes_stop_the_reader():
    rng = random.Random(9)
    hostile = [b"X-Page-ID: --5", "X-Page-ID: ²".encode(), b"X-Page-ID: " + b"9" * 5000, b"X-Page-ID: " + b"9" * 30, b"X-Refers-To-Page-ID: 1e9", b"\xff\xfe: \x00"]
    parts = [b"WARC/1.1\r\nWARC-Type: response\r\n" + h + b"\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n" for h in hostile]
    parts += [b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 52\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 99999999999999999999\r\n\r\n"]
    for size in (b"9" * 5000, b"99999999999", "²".encode(), b"-1", b""):
        parts.append(b"WARC/1.1\r\nContent-Length: " + size + b"\r\n\r\nabc\r\n\r\n")
    plain = b"".join(x for k, p in enumerate(parts) for x in (p, record(k, b"good")))
    rows = [warc.row("p", *x, True) for x in warc.salvage(plain)]
    warc.frame(rows)
    assert [r[6] for r in rows if r[0] == "record" and r[6] is not None] == list(range(len(parts)))
    whole = b"".join(gzip.compress(p) for p in parts) + plain
    for k in range(300):
        hurt = bytearray(rng.choice([plain, whole, gzip.compress(plain) + plain]))
        for _ in range(rng.choice([1, 3, 30])):
            at = rng.randrange(len(hurt)) if k % 2 else rng.randrange(40)
            hurt[at : at + rng.choice([0, 1, 5])] = rng.randbytes(rng.choice([0, 1, 5]))
        out = list(warc.salvage(bytes(hurt)))
        warc.frame([warc.row("p", *x, True) for x in out])
        assert sum(x[2] for x in out if x[0] == "gap") <= len(hurt)


def test_archives_are_streamed(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    parts = [record(n, rng.randbytes(rng.choice([10, 3000, 70_000]))) for n in range(60)]
    data = b"".join(parts[:30]) + b"\0" * 5000 + b"".join(gzip.compress(p) for p in parts[30:])
    monkeypatch.setattr(warc, "READ", 1000)
    whole = list(warc.salvage(data))
    assert whole == list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(data)
    (tmp_path / "w" / "b.warc").write_bytes(parts[0])
    for most in (0, 10_000, 1 << 30):
        records, gaps = warc.salvaged(spark, f"{tmp_path}/w") if most == 1 << 30 else (warc.read_warc(spark, f"{tmp_path}/w", True, most).filter(f"kind = '{k}'") for k in ("record", "gap"))
        assert sorted(r["page_id"] for r in records.collect()) == sorted([0, *range(60)]) and [r["length"] for r in gaps.collect()] == [5000]


def test_salvage_takes_linear_time():
    import time

    def seconds(data):
        start = time.time()
        for _ in warc.salvage(data):
            pass
        return time.time() - start

    for one in (gzip.compress(record(1, b"x")), b"WARC/1.1\r\nContent-Length: 7\r\n", b"WARC/1.1\r\nContent-Length: 99999\r\n\r\nabc\r\n\r\n"):
        few, many = min(seconds(one * 2000) for _ in range(3)), seconds(one * 16_000)
        assert many < 24 * few + 0.5


def test_fertility(spark, odd, empty):
    pieces = fertility.Pieces(PIECES)
    for _, text, *_ in documents()[:60] + [(0, None), (0, "a b c a b c a b"), (0, "x\nx\n\n\nx")]:
        n, chars, symbols, lines, repeated, total, _, _, _ = fertility.measure(text, pieces)
        words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
        three = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
        split = (text or "").split("\n")
        dup = sum(1 for i, x in enumerate(split) if regex.search(r"[^\x20\x09-\x0D]", x) and x in split[:i])
        assert (n, chars, repeated, lines) == (len(words), sum(map(len, words)), len(hit), dup)
        assert symbols == len(regex.findall(r"[#*$%&|<>]", text or ""))
        assert total == sum(len(pieces.sp.encode(w)) for w in words)
    rows = fertility.fertility_rules(odd, PIECES).collect()
    assert len(rows) == 11 and all(not r["kept"] for r in rows if r["base_failed"])
    assert fertility.fertility_rules(empty, PIECES).count() == 0
    known = {d: q for d, q in connection(SF).execute("SELECT doc_id, quality FROM labels").fetchall()}
    good = [r for r in fertility.fertility_rules(common.table(spark, SF, "documents"), PIECES).collect() if known.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert all(r["kept"] for r in good) and good


def test_fertility_bands_reject_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in fertility.fertility_rules(common.table(spark, sf, "documents"), PIECES).collect() if not r["base_failed"] and r["doc_id"] in known]
    junk, clean = ([r["kept"] for r in rows if known[r["doc_id"]] == q] for q in (0, 1))
    assert sum(junk) <= 0.4 * len(junk) and sum(clean) >= 0.99 * len(clean)


def test_bands_equal_brute_force(spark, odd):
    """Medians, median absolute deviations, shrinking and the verdict, from the measures of every row."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 > 0, F.col("lang")).alias("lang"))
    docs = docs.unionByName(odd.select("doc_id", "text", "lang")).unionByName(spark.createDataFrame([(90_000 + k, "слово и дело " * (18 + k) + " ".join(f"к{j}" for j in range(60)), "ru") for k in range(6)], "doc_id long, text string, lang string"))
    rows = fertility.fertility_rules(docs, PIECES).collect()
    good = [r for r in rows if not r["base_failed"]]
    middle = lambda x: sorted(x)[-(-len(x) // 2) - 1]
    names = [*fertility.MEASURES, "n_sp_tokens"]
    every = {m: middle([r[m] for r in good]) for m in names}
    by = defaultdict(list)
    for r in good:
        by[r["band_group"]].append(r)
    assert {"script latin", "group en", "group ru"} <= set(by)
    share = {g: len(x) / (len(x) + 50) for g, x in by.items()}
    centre = {g: {m: share[g] * middle([r[m] for r in x]) + (1 - share[g]) * every[m] for m in names} for g, x in by.items()}
    off = lambda r, m: abs(r[m] - centre[r["band_group"]][m])
    common_off = {m: middle([off(r, m) for r in good]) for m in names}
    wide = {g: {m: share[g] * middle([off(r, m) for r in x]) + (1 - share[g]) * common_off[m] for m in names} for g, x in by.items()}
    for r in rows:
        want = not r["base_failed"]
        if want:
            g = r["band_group"]
            stretch = max(1, centre[g]["n_sp_tokens"] / max(1, r["n_sp_tokens"])) ** 0.5
            edges = [(off(r, m), max(fertility.FLOORS[m], 6 * stretch * wide[g][m])) for m in fertility.MEASURES]
            if any(abs(a - b) < 1e-9 for a, b in edges):
                continue
            want = all(a <= b for a, b in edges)
        assert r["kept"] == want
    assert sum(not r["kept"] for r in good) >= 10


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>menu</li></ul></nav><div class='ad x'>buy</div><article><h1>A &amp; B</h1><p><b>one<br>two\n three<p>four &lt;5<ul><li>x<li>y</ul><div class=comments>no</div></article><footer>&copy;</footer><script>var t='</p>';</script>"
    assert style_tree.main_text(page, None) == "A & B\none two three\nfour <5\nx\ny"
    for bad in ("", None, "<", "<p", "a<b", "<!--", "</p></p>x", "<p>" * 3000 + "x", "&#xZZ; &am"):
        style_tree.main_text(bad, [])


def test_style_tree_prunes_what_pages_share(spark):
    make = lambda i: f"<body><div class='top'>Our site, all days</div><div class='text'><p>Story {i} alone</p><p>and more of {i * 7}</p></div><div class='end'>Contact us</div></body>"
    rows = [(i, f"http://h.org/{i}", make(i)) for i in range(12)] + [(50, None, None), (51, "no url", ""), (52, "http://one.org/", make(99))]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, salt string, low string")
    got = {r["page_id"]: r for r in style_tree.extract(pages).collect()}
    assert got[3]["text"] == "Story 3 alone\nand more of 21" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[50]["text"] == got[51]["text"] == "" and got[52]["text"] == "Story 99 alone\nand more of 693"  # by the common tree
    assert style_tree.extract(pages.limit(0)).count() == 0


def test_style_tree_prunes_inside_articles(spark):
    make = lambda i: f"<body><article class='post'><p>Story {i} alone</p><div class='k9'>The same on all pages</div></article></body>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", make(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()} == {i: f"Story {i} alone" for i in range(12)}


def test_copies_of_a_page_are_one_page_of_the_tree(spark):
    for tag in ("article", "div"):
        make = lambda i: f"<body><div class='page'><{tag}><p>Story {i} alone</p><p>and more of {i * 7}</p></{tag}></div></body>"  # noqa: E731, B023
        pages = spark.createDataFrame([(i, f"http://h.org/{i}", make(max(i, 80))) for i in range(100)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
        assert got == {i: f"Story {max(i, 80)} alone\nand more of {max(i, 80) * 7}" for i in range(100)}
    # near copies, the same but for a comment: an article stays all the same
    make = lambda i: f"<body><div class='page'><article><p>Story {max(i, 80)} alone</p></article></div><!--{i}--></body>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", make(i)) for i in range(100)], "page_id long, url string, html string")
    assert all(style_tree.MAIN_END and r["low"] == ["/body/div.page/article/p"] for r in style_tree.low_branches(pages).collect())


def test_deep_and_broken_pages():
    text = style_tree.main_text
    assert text("<nav>" + "<div>" * 70 + "menu</nav><article>Real text</article>", None) == "Real text"
    for depth in (1000, 20_000):
        assert text("<div>" * depth + "deep", None) == "deep"
        assert text("<nav>" + "<div>" * depth + "menu" + "</div>" * depth + "</nav><p>Real", None) == "Real"
    assert text("<p>a" + "<b>" * 100 + "b<div>c</div>", None) == "ab\nc"
    assert text("<div class='share-price'>12 euros</div><div class='related-work'>Others</div><div class='share-buttons'>x</div><div id='site-footer'>y</div><div class='post-comments'>z</div>", None) == "12 euros\nOthers"
    assert text("<div class='w-1/2'>half</div>", ["/div.w-1"]) == "half"
    start = time.time()
    text("<div><b><li><p>" * 20_000, None)
    assert time.time() - start < 20


def test_hosts_of_few_pages_use_the_common_tree(spark):
    make = lambda i: f"<body><div class='k'>All about us and more</div><div class='t'><p>Story {i} alone</p></div></body>"
    rows = [(100 * h + i, f"http://h{h}.org/{i}", make(100 * h + i)) for h in range(3) for i in range(10)] + [(900, "http://one.org/", make(900)), (901, "http://two.org/", make(901)), (902, "http://two.org/2", make(902))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()} == {i: f"Story {i} alone" for i, _, _ in rows}
    # alone, two near copies are no evidence
    pair = spark.createDataFrame([(1, "http://p.org/1", make(1)), (2, "http://p.org/2", make(1) + "<!-- -->")], "page_id long, url string, html string")
    assert all("Story 1 alone" in r["text"] for r in style_tree.extract(pair).collect())


def test_pages_table(spark):
    rows = style_tree.query(spark, SF).collect()
    assert len(rows) == 50 and all(r["text"] and "var t" not in r["text"] and "©" not in r["text"] for r in rows)


def test_wand_equals_exhaustive_scores():
    items = connection(SF).execute("SELECT item_id, text FROM benchmark").fetchall() + [(None, None), (900, ""), (901, "one")]
    index = decontamination.Index(items)
    rng = random.Random(5)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.term)), rng.randrange(1, 90)))
        scores = Counter()
        for t in terms:
            for p, w in zip(index.postings[t], index.weights[t]):
                scores[p] += w
        least = rng.choice([0.02, 0.1, 0.3])
        got = dict(index.search(terms, least))
        assert set(got) == {p for p, s in scores.items() if s >= least - 1e-9}


def test_leaks(spark, odd, empty):
    benchmark = common.table(spark, SF, "benchmark")
    items = dict(connection(SF).execute("SELECT item_id, text FROM benchmark").fetchall())
    words = [w for r in documents()[:30] for w in r[1].split()]
    rows = [(100 + i, " ".join(words[50 * i : 50 * i + 333]) + " " + t.upper() + " " + " ".join(words[:200]), None, None, None) for i, t in items.items()]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert {(100 + i, i) for i in items} <= got
    full = {(d, i) for d, t, *_ in documents() for i, b in items.items() if b in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark, SF).collect()}
    assert full <= found and len(found - full) <= 2
    assert decontamination.contaminated(odd, benchmark).count() == 0
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.clean(odd, benchmark).columns == odd.columns


def brute_leaks(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """Every passage against every item: BM25 by its formula, then the shares of shingles."""
    tokens = {i: decontamination.words(t) for i, t in items}
    df = Counter(t for w in tokens.values() for t in set(w))
    mean, longest = sum(map(len, tokens.values())) / len(tokens), max(map(len, tokens.values()))
    idf = {t: np.log(1 + (len(tokens) - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    weights = {}
    for i, w in tokens.items():
        c = Counter(w)
        x = {t: idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in c.items()}
        weights[i] = {t: v / sum(x.values()) for t, v in x.items()}
    out = set()
    for d, text in docs:
        w = decontamination.words(text or "")
        for a in range(0, len(w), longest):
            part, near = set(w[a : a + 2 * longest]), w[max(0, a - longest) : a + 3 * longest]
            for i, x in weights.items():
                if (d, i) not in out and sum(x[t] for t in part if t in x) >= 0.6 - 1e-9:
                    cut = len(tokens[i]) - max(1, len(tokens[i]) // 3)
                    have = [set(zip(*[near[k:] for k in range(n)])) for n in range(6)]
                    share = [sum(s in have[len(s)] for s in decontamination.shingles(side)) / len(decontamination.shingles(side)) for side in (tokens[i][:cut], tokens[i][cut:])]
                    if share[0] >= 0.6 and share[1] >= 0.5:
                        out.add((d, i))
    return out


def test_query_equals_brute_force(spark):
    items = connection(SF).execute("SELECT item_id, text FROM benchmark").fetchall()
    rng = random.Random(12)
    words = [w for r in documents()[:40] for w in r[1].split()]
    docs = [(d, t) for d, t, *_ in documents()]
    for k in range(60):  # pieces of items, some of which are enough
        t = rng.choice(items)[1].split()
        t = t[: rng.randrange(len(t) // 2, len(t))] if k % 2 else [rng.choice(words) if rng.random() < 0.03 * (k % 5) else x for x in t]
        docs.append((10_000 + k, " ".join(rng.sample(words, 150) + t + rng.sample(words, 90))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, common.table(spark, SF, "benchmark")).collect()}
    want = brute_leaks(docs, items)
    assert found == want and len(want) > 20


def test_parts_and_lengths_of_the_index_change_nothing(spark):
    benchmark = common.table(spark, SF, "benchmark")
    words = [w for r in documents()[:40] for w in r[1].split()]
    long = " ".join(words[:3000])
    benchmark = benchmark.unionByName(spark.createDataFrame([(5000, long), (1, "another version of the first item with words of its own in it")], "item_id long, text string"))
    docs = common.table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(9000, "before it " + long + " after it"), (9001, long[:4000])], "doc_id long, text string"))
    rows = lambda **k: sorted(map(tuple, decontamination.contaminated(docs, benchmark, **k).collect()))
    whole = rows()
    assert whole == rows(part_chars=300) and [r[:2] for r in whole if r[0] >= 9000] == [(9000, 5000)]
    left = lambda **k: {r["doc_id"] for r in decontamination.clean(docs, benchmark, **k).collect()}
    assert left() == left(part_chars=2000) == {r["doc_id"] for r in docs.collect()} - {r[0] for r in whole}
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert sorted(int(r["doc_id"][1:]) for r in decontamination.contaminated(named, benchmark.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text")).collect()) == sorted(r[0] for r in whole)


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], np.int64).view(np.uint64)
    forest = simhash.Forest(len(ids))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    forest.union(i, j)
    return {d: ids[r] for d, r in zip(ids, forest.roots(np.arange(len(ids))).tolist())}


def brute_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for text in [r[1] for r in documents()[:25]] + [None, "", "A b", "a B c D", "É a b c d e"]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_near_duplicates(spark, odd, empty):
    rows = simhash.query(spark, SF).collect()
    want = brute_components({d: simhash.fingerprint(t) for d, t, *_ in documents()})
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    got = simhash.near_duplicates(odd).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert len(got) == 11 and by[1] == by[8] == {1} and by[2] == by[3] == by[4] == {2} and None in by[None] | {None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 5, 6, 7, None])  # the null id's empty text goes with document 2's
    assert simhash.keep_one(empty).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    texts = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcd"}
    rows = [(1, "a"), (3, "b"), (5, "a"), (5, "b"), (7, "c"), (None, "c"), (None, "d")]
    docs = spark.createDataFrame([(i, texts[c], None, None, None) for i, c in rows], DOCS)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter({(1, 1): 1, (3, 1): 1, (5, 1): 2, (7, 7): 1, (None, 7): 1, (None, None): 1})
    # of different texts under one id none is dropped, and the same row stays whatever the order
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(i, texts[c], None, None, None) for i, c in [*rows, (7, "c")]], DOCS).repartition(seed + 1)
        left = simhash.keep_one(docs).collect()
        assert Counter((r["doc_id"], r["text"][0]) for r in left) == Counter([(1, "a"), (3, "b"), (7, "c"), (None, "d")])


def test_many_cells_give_the_same_links(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 63, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 1500).astype(np.uint64))
    x = np.unique(np.concatenate([base, near]))
    fps = {int(i): int(v) for i, v in enumerate(x.view(np.int64))}
    want = brute_components(fps)
    names, met, forest = [], [], simhash.Forest(len(x))
    tree = simhash.grow(x, 5200, np.random.default_rng(1), names)
    assert len(names) > 5000
    simhash.route(tree, x, np.arange(len(x)), np.full(len(x), True), met)
    by = defaultdict(list)
    for c, at, home in met:
        by[c].append((at, home))
    for parts in by.values():
        at, home = (np.concatenate(v) for v in zip(*parts))
        for i, j in simhash.close_pairs(x[at], home):
            forest.union(at[i], at[j])
    assert dict(enumerate(forest.roots(np.arange(len(x))).tolist())) == want
    nodes = spark.createDataFrame([(v, i) for i, v in fps.items()], "fp long, node long")
    roots = {r["node"]: r["root"] for r in components.star_roots(simhash.links(nodes, 100)).collect()}
    assert {i: roots.get(i, i) for i in fps} == want


def brute_survivors(texts: dict[int, str | None]) -> set[int]:
    """The least id of each component of pairs of five-word Jaccard similarity 0.8 or more."""
    sets = {d: set(zip(*[(t or "").lower().split()[k:] for k in range(5)])) for d, t in texts.items()}
    ids = sorted(sets)
    forest = simhash.Forest(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if len(x & y) >= 0.8 * len(x | y):
                forest.union(np.array([i]), np.array([j]))
    return {d for i, d in enumerate(ids) if forest.roots(np.array([i]))[0] == i}


def test_keep_one_links_what_jaccard_links(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, at = {}, 1
    for size in (60, 150, 151, 400, 1100):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts[at] = " ".join(base)
            for k in range(1, 5):  # edits in places far apart, from well over 0.8 to under it
                copy = list(base)
                for e in range(max(1, k * size // 110)):
                    copy[rng.randrange(size)] = word()
                texts[at + k] = " ".join(copy)
            at += 5
    base = [word() for _ in range(200)]
    for k in range(300):  # a crowd, and around it texts that are alike to some of it and not to others
        copy = list(base)
        for _ in range(1 + 3 * (k % 3 == 0)):
            copy[rng.randrange(200)] = word()
        texts[at + k] = " ".join(copy)
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], DOCS)
    want = brute_survivors(texts)
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert want <= got and 60 < len(want) < 300 and len(texts) - len(got) >= 0.995 * (len(texts) - len(want))
    monkeypatch.setattr(simhash, "SET_SIZES", 5000)  # shards in several blocks and parts
    monkeypatch.setattr(simhash, "VERIFIED_AT_ONCE", 3)
    monkeypatch.setattr(simhash, "ROUNDS", 0)  # whole shards alone
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == got


def test_shared_hashes_are_counted_once(spark):
    rows = spark.createDataFrame([(1, b"abc", b"abd"), (2, b"abc", b"xyz")], "i int, a binary, b binary")
    found = rows.select("i", simhash.agreement("a", "b").alias("same")).filter("same >= 2")
    assert [r[:] for r in found.collect()] == [(1, 2)]
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_crowds_are_linked_exactly(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    crowd = np.full(900, base[0])
    for _ in range(4):
        crowd ^= np.uint64(1) << rng.integers(0, 12, len(crowd)).astype(np.uint64)
    near = base[1:200] ^ (np.uint64(1) << rng.integers(0, 63, 199).astype(np.uint64))
    x = np.unique(np.concatenate([base, crowd, near]))
    fps = {int(i): int(v) for i, v in enumerate(x.view(np.int64))}
    nodes = spark.createDataFrame([(v, i) for i, v in fps.items()], "fp long, node long")
    roots = {r["node"]: r["root"] for r in components.star_roots(simhash.links(nodes)).collect()}
    assert {i: roots.get(i, i) for i in fps} == brute_components(fps)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)]
    forest = simhash.Forest(2000)
    forest.union(*(np.array(x) for x in zip(*edges)))
    got = {r["node"]: r["root"] for r in components.star_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    for n in {x for e in edges for x in e}:
        assert got.get(n, n) == forest.roots(np.array([n]))[0]


def test_gradients():
    rng = np.random.default_rng(0)
    net = gru_langid.Gru(["a", "b", "c"], units=3)
    x = rng.integers(0, 256, (5, 4))
    x[3:, 1] = 256
    y = np.array([0, 1, 2, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(x, y)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False) if name[0] != "X" else [int(x[0, 0]) * 9 + j for j in (0, 4, 8)]:
            was = flat[k]
            flat[k] = was + 1e-3
            up = net.gradients(x, y)[0]
            flat[k] = was - 1e-3
            down = net.gradients(x, y)[0]
            flat[k] = was
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 2e-3


def test_languages(spark, odd, empty):
    truth = {d: lang for d, _, lang, *_ in documents()}
    rows = gru_langid.query(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    model = gru_langid.train(common.table(spark, SF, "documents"))
    got = {r["doc_id"]: r for r in gru_langid.identify(odd, model).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (2, 3, 4, 7)) and 0 < got[5]["score"] <= 1
    assert gru_langid.identify(empty).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ① 123 ٣ ％"), (2, "ª"), (3, "文")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in gru_langid.identify(signs, model).orderBy("doc_id").collect()] == [True, False, False]
    assert {r["lang_pred"] for r in gru_langid.identify(odd.filter("lang is null")).collect()} == {"und"}
    f, b = (model.direction(np.arange(64).reshape(16, 4), d)[0] for d in "fb")
    assert np.allclose(f, model.states(np.arange(64).reshape(16, 4), "f"), atol=1e-5) and np.allclose(b, model.states(np.arange(64).reshape(16, 4), "b"), atol=1e-5)


def test_site_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    docs = common.table(spark, sf, "documents")
    learn, held = labels.filter("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r["kept"] for r in site_quality.classify(docs, learn).collect()}
    assert sum(got[d] == (q == 1) for d, q in held.items()) >= 0.97 * len(held)
    assert site_quality.classify(odd, labels).count() == 11 and site_quality.classify(empty, labels).count() == 0
    assert all(r["kept"] for r in site_quality.classify(odd, labels.limit(0)).collect())
    assert site_quality.keep_good(odd, labels).columns == odd.columns


def test_rejected_rows_take_no_others_with_them(spark):
    sf = "/root/testdata/sf0.01"
    labels, docs = common.table(spark, sf, "labels"), common.table(spark, sf, "documents")
    kept = {r["doc_id"]: r["kept"] for r in site_quality.classify(docs, labels).collect()}
    bad = min(d for d, k in kept.items() if not k)
    good = sorted(d for d, k in kept.items() if k)[:3]
    new = F.when(F.col("doc_id").isin(bad, good[0]), F.lit(None)).when(F.col("doc_id") == good[1], min(d for d, k in kept.items() if not k and d != bad)).otherwise(F.col("doc_id"))
    hurt = docs.withColumn("was", F.col("doc_id")).withColumn("doc_id", new.cast("long"))
    # the two ids without labels change the fit next to nothing
    left = {r["was"] for r in site_quality.keep_good(hurt, labels).collect()}
    assert set(good) <= left and bad not in left


def test_sparse_sites_are_shrunk(spark):
    groups = spark.createDataFrame([(1000.0, 900.0), (1000.0, 100.0), (2.0, 0.0)], "n double, s double")
    assert site_quality.moments(groups, "n", "s", F.lit(0.5)) < 5
    same = spark.createDataFrame([(100.0, 50.0)] * 20, "n double, s double")
    assert site_quality.moments(same, "n", "s", F.lit(0.5)) == site_quality.MOST_STRENGTH


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = common.materialise(out, "test")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    texts = {d: t for d, t, *_ in documents()}
    items = [b for (b,) in connection(SF).execute("SELECT text FROM benchmark").fetchall()]
    assert not [d for d in ids if any(b in texts[d] for b in items)]
    groups = brute_components({d: simhash.fingerprint(texts[d]) for d in ids})
    assert all(d == g for d, g in groups.items())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
