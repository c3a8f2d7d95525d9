"""Vector codes, token links and WARC archives against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilmark.llm import queries as q
from tilmark.llm import token_links as tl
from tilmark.llm import vector_codes as vc
from tilmark.llm import warc

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
CLASHES = ["id", "v", "n", "row", "code", "error", "pair", "pairs", "times", "digest", "payload", "first", "of", "rest_of", "rows", "other", "text_", "place", "file", "begin", "end"]


def clashing(frame):
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


# --- vector codes


def codes_by_force(rows, parts=8, entries=16, rounds=6):
    """rows (id, label, vector) of usable vectors of one length, by exact Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ints = [[math.floor(x) * 4096 if abs(x) >= 2.0**52 else math.floor(4096 * x) for x in r[2]] for r in rows]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in cut:
                own[best(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else b for o, b in zip(own, books[p], strict=True)]
    out, by_label = [], Counter()
    for r, v in zip(rows, cut, strict=True):
        found = [best(x, b) for x, b in zip(v, books, strict=True)]
        error = min(vc.LONGEST, sum(d for d, _ in found))
        by_label[r[1]] += error
        out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in found), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), code, error, min(vc.LONGEST, by_label[label]), sha) for i, label, code, error in out)


def found_codes(frame, **named):
    return sorted((str(r[0]), *r[1:]) for r in vc.vector_codes(frame, **named).collect())


VECTORS = "vec_id long, embedding array<double>, label int"


def test_codes_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=16).round(2).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(200)]
    rows += [rows[5], rows[5], (3, rng.normal(size=16).tolist(), 1), (None, rows[9][1], 2), (None, rows[2][1], None)]
    odd = [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1)]
    frame = clashing(spark.createDataFrame(rows + odd, VECTORS).repartition(5))
    assert found_codes(frame) == codes_by_force([(a, c, b) for a, b, c in rows])


def test_codes_of_few_equal_and_huge_vectors(spark):
    few = [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (3, [-0.0001] * 8, None)]
    assert found_codes(spark.createDataFrame(few, VECTORS)) == codes_by_force([(a, c, b) for a, b, c in few])
    huge = [(i, [1e30 * (-1) ** i, 3e7 * i, *[0.25 * i] * 6], i % 2) for i in range(40)]
    assert found_codes(spark.createDataFrame(huge, VECTORS)) == codes_by_force([(a, c, b) for a, b, c in huge])


def test_codes_of_other_lengths_and_none(spark):
    rows = [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [3.0] * 16, 1), (4, [3.0] * 7, 1), (5, [], 1)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vc.vector_codes(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: ("01" * 8, 0, 0), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, 0)}
    assert vc.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="hex"):
        vc.vector_codes(spark.createDataFrame(rows, VECTORS), entries=300)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 16), st.integers(1, 6), st.booleans())
def test_partial_distances_lose_no_entry(seed, entries, width, objects):
    """Small numbers, so that ties are frequent."""
    rng = np.random.default_rng(seed)
    rows, book = rng.integers(-3, 4, (50, width)), rng.integers(-3, 4, (entries, width))
    want = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    kind = object if objects else np.int64
    code, far = vc.nearest(rows.astype(kind), book.astype(kind), vc.falling_variance(book))
    assert code.tolist() == want.argmin(axis=1).tolist()
    assert far.tolist() == want.min(axis=1).tolist()


def test_dimensions_come_in_falling_variance():
    book = np.array([[0, 5, 1], [0, -5, 2], [0, 9, 2]])
    assert vc.falling_variance(book) == [1, 2, 0]


# --- token links


@pytest.fixture(scope="module")
def tokenizers():
    with open(tl.BYTES, "rb") as f, open(tl.PIECES, "rb") as g:
        return tl.Pair(f.read(), g.read())


def force_text(pair, text):
    """Tokens, groups and links of one text, from its bytes."""
    if not text:
        return [], [], [], []
    (a,), (b,) = pair.encode([text])
    raw = f" {text}".encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return [], [], [], []
    spans = []
    for ids, own in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(own[i]), i))
            at += len(own[i])
        spans.append(out)
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [(",".join(str(i) for s, e, i in spans[0] if lo <= s and e <= hi), ",".join(str(i) for s, e, i in spans[1] if lo <= s and e <= hi)) for lo, hi in zip([0, *ends], ends, strict=False)]
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    return a, b, groups, links


def force_links(pair, texts):
    each = [force_text(pair, t) for t in texts]
    counts = Counter(x for e in each for x in e[3])
    highest: dict[int, int] = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for a, b, groups, links in each:
        sha = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


ODD_TEXTS = [
    None, "", " ", "  two  blanks ", "a\nb \n c\t", "<|endoftext|> and <s> </s> <unk> <0x41>", "with ▁ inside", "▁", "naïve café 日本語 שלום 😀😀", "x" * 3000, "   x y 　z ", "don't can't I'll",
    "a​b ​ c", "\x00nul \x1c sep", "word " * 500, "1234567890 12 3", "é ́", "tail ", "\n\n\n", "ﬁ Ⅳ ｆｕｌｌ",
]


def links_of(frame, **named):
    return sorted((str(r["doc_id"]), *[r[c] for c in (*tl.NUMBERS, "n_best", "count_sum", "groups_sha256")]) for r in tl.token_links(frame, **named).collect())


def test_links_are_those_of_brute_force(spark, tokenizers):
    texts = [*ODD_TEXTS, "the same text twice", "the same text twice"]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    frame = clashing(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3))
    want = sorted((str(i), *w) for i, w in zip(ids, force_links(tokenizers, texts), strict=True))
    assert links_of(frame) == want
    assert links_of(frame, broadcast=7) == want  # few pairs are broadcast, the others are joined by a shuffle
    assert tl.token_links(frame.limit(0)).collect() == []


def test_unpairable_texts_have_no_tokens(tokenizers):
    assert force_text(tokenizers, "with ▁ inside") == ([], [], [], [])
    rows = list(tl.Aligner(tokenizers).texts(["with ▁ inside", None, ""]))
    assert [r[:5] for r in rows] == [(0, 0, 0, 0, "")] * 3


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\tab'É日.1 ​▁<s>0x"), max_size=40))
def test_units_are_as_whole_texts(text):
    with open(tl.BYTES, "rb") as f, open(tl.PIECES, "rb") as g:
        pair = tl.pair_of(f.read(), g.read())
    a, b, groups, links = force_text(pair, text)
    n_a, n_b, n_groups, n_links, sha, pairs, times = next(tl.Aligner(pair, remembered=3).texts([text]))
    assert (n_a, n_b, n_groups, n_links) == (len(a), len(b), len(groups), len(links))
    assert sha == (hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else "")
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == Counter(i << 32 | j for i, j in links)


def test_union_find_is_that_of_one_link_at_a_time():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 30)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30))]
        want = list(range(n))
        for a, b in links:
            x, y = want[a], want[b]
            want = [min(x, y) if w in (x, y) else w for w in want]
        got = tl.united(n, np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
        assert got.tolist() == want


@needs_tables
def test_links_of_the_test_table(spark, tokenizers):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows}
    a, b = tokenizers.encode([t or "" for t in short.values()])
    got = {r["doc_id"]: r for r in q.op12_token_links(spark, SMALL).collect()}
    assert [got[i]["n_a"] for i in short] == [len(x) if t else 0 for x, t in zip(a, short.values(), strict=True)]
    assert [got[i]["n_b"] for i in short] == [len(x) if t else 0 for x, t in zip(b, short.values(), strict=True)]
    few = [i for i, t in short.items() if t and len(t) < 2000][:30]
    for i in few:
        _, _, groups, links = force_text(tokenizers, short[i])
        assert (got[i]["n_groups"], got[i]["n_links"], got[i]["groups_sha256"]) == (len(groups), len(links), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest())


# --- WARC


PAGES = "page_id long, url string, html string"


def records_by_force(rows, least=0):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r)
    out = []
    for text, members in groups.items():
        raw = text.encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        members.sort(key=lambda r: (r[0] is None, r[0] or 0))
        for k, r in enumerate(members):
            own = k == 0 or len(raw) < least
            out.append((str(r[0]), len(raw), sha, "response" if own else "revisit", None if own else members[0][0]))
    return sorted(out, key=str)


def page_rows():
    rng = random.Random(2)
    rows = [(i, f"http://a/{i}", rng.choice(["", None, "<p>same</p>", f"<p>{i} ü \r\n\r\n WARC/1.1\r\n</p>"])) for i in range(60)]
    big = "".join(f"<p>{i} {rng.random()}</p>" for i in range(120_000))
    return [*rows, (70, None, big), (71, "http://b\r\nx: y", big), rows[3], rows[3], (5, "http://other", rows[5][2]), (None, None, "<p>same</p>"), (None, None, "<i>no id</i>"), (None, None, "<i>no id</i>"), (80, "u", "WARC/1.1\r\n")]


def found_records(frame):
    return sorted(((str(r[0]), *r[1:]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_records_are_those_of_brute_force(spark, least):
    rows = page_rows()
    frame = clashing(spark.createDataFrame(rows, PAGES).repartition(3))
    assert found_records(warc.archive_pages(frame, least=least)) == records_by_force(rows, least)
    assert warc.archive_pages(frame.limit(0)).collect() == []


def test_many_groups_are_joined_by_a_shuffle(spark):
    rows = [(i, f"u{i}", f"<p>{i % 40 if i < 400 else 0}</p>") for i in range(600)] + [(3, "u3", "<p>3</p>")]
    made = warc.decided(warc.keyed(spark.createDataFrame(rows, PAGES)), broadcast=3).collect()
    first = {f"<p>{i}</p>": i for i in range(40)}
    want = Counter((i, "response" if n == 0 and first[h] == i else "revisit", None if n == 0 and first[h] == i else first[h]) for n, i, h in [(0, *(r[0], r[2])) for r in rows[:600]] + [(1, 3, "<p>3</p>")])
    assert Counter((r["id"], r["record_type"], r["refers_to"]) for r in made) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in made)


def test_archives_hold_the_pages(spark, tmp_path):
    """Ranges are small, files many, and chunks cut payloads; the table gives back every byte, and another reader of gzip sees the same records."""
    rows = page_rows()
    folder = f"{tmp_path}/archives"
    manifest = warc.write_archives(warc.decided(warc.keyed(spark.createDataFrame(rows, PAGES).coalesce(2))), folder, span=3000, most=1_500_000)
    assert manifest.count() > 5
    for source in (manifest, warc.archive_files(spark, folder)):
        table = warc.read_archives(source, chunk=1000).withColumn("k", F.monotonically_increasing_id()).collect()
        payloads, open_ = Counter(), b""
        for r in table:
            if r["record_type"] == "revisit":
                payloads[r["page_id"], None] += 1
                continue
            assert r["chunk"] == len(open_) // 1000
            open_ += bytes(r["content"])
            assert r["so_far"] == len(open_)
            if r["final"]:
                assert r["payload_digest"] == base64.b32encode(hashlib.sha1(open_).digest()).decode()
                payloads[r["page_id"], open_] += 1
                open_ = b""
        want = Counter()
        for page, n, _, kind, _ in records_by_force(rows):
            raw = next((r[2] or "").encode() for r in rows if str(r[0]) == page and len((r[2] or "").encode()) == n)
            want[None if page == "None" else page, raw if kind == "response" else None] += 1
        assert payloads == want
    files = os.listdir(folder)
    assert len(files) > 2
    whole = b"".join(gzip.open(f"{folder}/{f}").read() for f in files)
    assert len(re.findall(rb"(?m)^WARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>\r$", whole)) == len(rows)


def test_what_a_lost_task_left_is_not_read(spark, tmp_path):
    folder = f"{tmp_path}/archives"
    manifest = warc.write_archives(warc.decided(warc.keyed(spark.createDataFrame([(1, "u", "x")], PAGES))), folder)
    with open(f"{folder}/left.warc.gz", "wb") as f:
        f.write(b"broken")
    assert warc.read_archives(manifest).count() == 1


def plain_archive(*records: tuple[dict, bytes]) -> bytes:
    return b"".join(b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in (f | {"Content-Length": len(b)}).items()) + b"\r\n" + b + b"\r\n\r\n" for f, b in records)


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\nServer: x\n\nbody \r\n\r\n text"
    made = plain_archive(({"WARC-Type": "warcinfo"}, b"software: x\r\n"), ({"WARC-Type": "response", "Content-Type": "application/http;msgtype=response", "WARC-Target-URI": "http://a\r\n  b"}, http), ({"WARC-Type": "resource", "Content-Type": "text/plain"}, b""), ({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.1 204 No"))
    (tmp_path / "a.warc").write_bytes(made)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(made))
    got = warc.read_archives(warc.archive_files(spark, str(tmp_path))).filter("final").select("record_type", "url", "payload_bytes", "content").collect()
    one = [("response", "http://a b", 14 + 2, b"body \r\n\r\n text"[:16]), ("resource", None, 0, b""), ("response", None, 0, b"")]
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=str) == sorted([(k, u, len(b), b) for k, u, _, b in one] * 2, key=str)


@pytest.mark.parametrize("cut", [5, 60, 200, 260])
def test_broken_archives_are_errors(cut):
    made = plain_archive(({"WARC-Type": "resource", "WARC-Payload-Digest": f"sha1:{warc.base32_sha1(hashlib.sha1(b'x' * 300).digest())}"}, b"x" * 300))
    assert [r["payload_bytes"] for r in warc.records(warc.Source(io.BytesIO(made), 0, None))] == [300]
    for bad in (made[:cut], made.replace(b"xxxx", b"xxxy", 1)):
        with pytest.raises(ValueError, match="breaks off|differs"):
            list(warc.records(warc.Source(io.BytesIO(bad), 0, None)))
    packed = gzip.compress(made)
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(warc.Source(io.BytesIO(packed[: len(packed) - 30]), 0, None)))


def test_a_long_record_is_never_whole_in_memory():
    """64 MB of payload, a chunk at a time."""
    import tracemalloc

    made = io.BytesIO()
    warc.write_record(made, warc.header("response", 1, "u", 64 << 20, hashlib.sha1(bytes(64 << 20)).hexdigest(), None, 64 << 20).replace(b"application/http; msgtype=response", b"text/html"), (bytes(1 << 20) for _ in range(64)))
    tracemalloc.start()
    n = sum(1 for _ in warc.records(warc.Source(made, 0, None)))
    assert n == 64
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
