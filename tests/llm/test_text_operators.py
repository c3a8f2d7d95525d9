"""Brute-force versions, exact round trips and held-out accuracy of the operators on texts."""

from __future__ import annotations

import hashlib
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilmark.llm import bag_minhash as bm
from tilmark.llm import decontaminate as dc
from tilmark.llm import language_id as li
from tilmark.llm import license_scan as ls
from tilmark.llm import near_dedup as nd
from tilmark.llm import quality as qu
from tilmark.llm import queries as q
from tilmark.llm import secret_scan as ss
from tilmark.llm import textvec as tv
from tilmark.llm import token_scan as ts

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_word_hashes_are_words(monkeypatch):
    texts = ["Ab cd-ef ÉA 12x", None, "", "-- ", "ab", "x" * 5000 + " ab " + "y" * 3000, "ab\ncd"]
    whole = tv.word_hashes(texts)
    names: dict[str, int] = {}
    for i, t in enumerate(texts):
        own = whole[0][whole[1][i] : whole[1][i + 1]].tolist()
        words = tv.WORD.findall((t or "").lower())
        assert len(own) == len(words)
        assert all(names.setdefault(w, h) == h for w, h in zip(words, own, strict=True))
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(tv, "PIECE", 64)
    cut = tv.word_hashes(texts)
    assert np.array_equal(cut[0], whole[0])
    assert np.array_equal(cut[1], whole[1])


def test_license_blocks_and_places(spark):
    texts = ["under THE mit-license, and under the MIT License", "x " * 70 + "This work is licensed under the GNU General Public License, version 2.", "cc by nc cc by nc", "licensed under a free licence", "apache license version 2", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ls.license_scan(frame).collect()}
    assert [(p["start"], p["label"]) for p in got[0]["places"]] == [(0, "mit"), (5, "mit")]
    assert {m["label"] for m in got[1]["matches"]} == {"gpl"}
    assert [p["start"] for p in got[2]["places"]] == [0, 3]
    assert (got[3]["places"], got[3]["matches"]) == ([], [])
    assert [p["label"] for p in got[4]["places"]] == ["apache-2"]
    assert (got[5]["n_words"], got[5]["places"]) == (0, [])


def contained(words, templates):
    """Brute force: blocks of every template's own size with at least the threshold of its distinct words."""
    out = set()
    for number, (t, label) in enumerate(templates):
        own, step = set(t.split()), ls.step_of(t)
        for a in range(0, len(words), step):
            share = len(own & set(words[a : a + 2 * step])) / len(own)
            if share >= ls.THRESHOLD - 1e-12:
                out.add((a, 2 * step, label, share))
    return out


def test_templates_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(ls, "GROUP_TEMPLATES", 3)
    rng = np.random.default_rng(9)
    templates = [(" ".join(f"t{rng.integers(0, 3 * m + 4)}" for _ in range(m)), f"l{m}") for m in (1, 2, 5, 31, 32, 33, 34, 45, 64, 65, 71, 80, 129, 200, 300)]
    rows = []
    for k, (t, _) in enumerate(templates):
        for offset in (0, 1, 26, 63, 64, 150):
            own = t.split()
            if k % 3 == 1:
                own[len(own) // 2] = "other"
            rows.append(" ".join([f"b{i}" for i in range(offset)] + own + ["after"] * 9))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: {(m["start"], m["words"], m["label"], m["containment"]) for m in r["matches"]} for r in ls.license_scan(frame, templates=templates).collect()}
    for i, text in enumerate(rows):
        assert got[i] == contained(text.split(), templates), i
        if i // 6 % 3 != 1:
            assert templates[i // 6][1] in {label for _, _, label, _ in got[i]}


@needs_tables
def test_base_spans_as_stated(spark, docs):
    extra = {-1: 'my PassWord = "abcdef123456" token:short api-key=zzzzzzzzzzzzzz API_KEY: QWERTYqwerty12 ſecret=abcdefghijkl', -2: "AKIA" + "A1" * 8 + " AKIASHORT 0123456789abcdef0 deadbeefdeadbee"}
    names = "(?:password|passwd|secret|token|api_?key)"
    for text in [*docs.values(), *extra.values()]:
        want = [(m.start(), 0, m.end()) for m in re.finditer(rf"""(?ai:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert sorted(ss.base_spans(text)) == sorted(want)
    assert len(ss.base_spans(extra[-1])) == 2
    rows = q.op7_secret_scan(spark, SMALL).collect()
    for r in rows:
        spans = sorted(ss.base_spans(docs[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest() == ss.digest(spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_constants_flow_into_names():
    text = 'base = "Zk93jfkQ02lq"\nurl = "http://a.example/path1"\nfull = base + "Xy12"\nDB_PASSWORD = full\n{"clientSecret": "aB3dE5fG7hJ9"}\npassword_hint = "Zk93jfkQ02lqA"\nauth_token: ${TOKEN_FROM_ENV}\nsecret = "changeme1234"\ncolor = "Zk93jfkQ02lqB"\n'
    found = {text[a:b] for a, _, b, _ in ss.literal_spans(text)}
    assert found == {"Zk93jfkQ02lq", "Xy12", "aB3dE5fG7hJ9"}


def test_typed_and_chained_assignments():
    lit = "S3cr3tValue99x!"
    for text in (
        f'passphrase: str = "{lit}"', f'val privateKey: String = "{lit}"', f'INFO: pwd="{lit}"', f"const passphrase: string | null = '{lit}'",
        f'let PASSPHRASE: &\'static str = "{lit}";', f'var passphrase: String? = "{lit}"', f'passphrase: Optional[str]="{lit}"', f'passphrase?: Array<Map<string, string>> = "{lit}"',
        f'def f(a: int, pwd: str = "{lit}")', f'INFO: the pwd = "{lit}"', f'first = pwd = last = "{lit}"', f'pwd = first = "{lit}"', f'INFO: base="{lit}"\nDB_PWD = base',
        f'level: pwd: "{lit}"', f'x: std::string = "a"\npwd: std::string = "{lit}"',
    ):
        assert [text[a:b] for a, _, b, _ in ss.literal_spans(text)] == [lit], text
    assert [b - a for a, _, b, _ in ss.literal_spans("INFO: pwd=S3cr3tValue99x")] == [14]
    assert [b - a for a, _, b, _ in ss.literal_spans("url: http://a.example/x/pwd=S3cr3tValue99x")] == [14]
    assert [b - a for a, _, b, _ in ss.literal_spans("client_secret: S3cr3tValue99xYz=\nnext = 1")] == [17]
    for text in ('name: str = "Zk93jfkQ02lq"\npassword: str\nsecret = str(x)', "passphrase: str = None", f'first: Kind = "{lit}"\npassword: Kind', 'x: String? = "pwd: Zk93jfkQ02lq"'):
        assert ss.literal_spans(text) == [], text


def test_literals_of_any_length_and_number():
    value = "".join(f"aB3{i}" for i in range(3000))
    for text in (f'private_key = "{value}"', f"private_key = '{value}'", f"private_key = {value}", f"private_key: `{value}`"):
        at = text.index(value)
        assert [(a, b) for a, _, b, _ in ss.literal_spans(text)] == [(at, at + len(value))]
    many = [f"Part{i:03d}x" for i in range(200)]
    text = "base = " + " + ".join(f'"{x}"' for x in many) + "\nDB_PASSWORD = base\n"
    assert [text[a:b] for a, _, b, _ in ss.literal_spans(text)] == many
    doubled = 'a = "Zk93"\n' + "a = a + a\n" * 3000 + "secret = a\n"
    assert [doubled[a:b] for a, _, b, _ in ss.literal_spans(doubled)] == ["Zk93"]
    chained = 'a = "Zk93"\n' + 'a = a + "Qx7"\n' * 5000 + "secret = a\n"
    assert len(ss.literal_spans(chained)) == 5001
    hidden = 'a = "your"\nb = "Zk93jfkQ02lq"\nc = a + b\nsecret = c\n'
    assert ss.literal_spans(hidden) == []


def literals(text):
    return [text[a:b] for a, _, b, _ in ss.literal_spans(text)]


def test_syntax_of_many_languages():
    lit = "S3cr3tValue99x!"
    for text in (
        f'pwd = """{lit}"""', f"pwd = '''{lit}'''", f'pwd = f"{lit}"', f'pwd = b"{lit}"', f'pwd = R"{lit}"', f'pwd = (\n    "{lit}"\n)', f'pwd = \\\n    "{lit}"',
        f'const char pwd[] = "{lit}";', f'const char *pwd = "{lit}";', f'String password = "{lit}";', f'var password string = "{lit}"', f'config["password"] = "{lit}"', f'pwd += "{lit}"',
        f'passwords:\n  - "{lit}"\n', f'password:\n  "{lit}"\n', f"pwd: |\n  {lit}\nnext: 1", f"<password>{lit}</password>", f'<add key="dbPassword" value="{lit}"/>', f'<property name="password">\n</property><secret id="x">{lit}</secret>',
        f"run --password '{lit}' --next", f'#define API_KEY "{lit}"', f'# password = "{lit}"', f'/* pwd = "{lit}" */', f'say("password: \'{lit}\'")', f'don\'t = can\'t; pwd = "{lit}"', f'`password = "{lit}"`', f"pwd => '{lit}'",
        f'x = {{"a": 1, "clientSecret": "{lit}"}}', f'key = "{lit}"\ndef f():\n    password = key\n', f'def f():\n    key = "{lit}"\n    if x:\n        password = key\n',
        f'function a() {{ const k = "{lit}"; if (x) {{ password = k; }} }}', f'a = "{lit}"\nb = f"{{a}}"\nsecret = b\n',
    ):
        assert literals(text) == [lit], text
    assert literals("run --password S3cr3tValue99x --next") == ["S3cr3tValue99x"]
    assert literals('pwd = "S3cr3tVal" "ue99xQ"') == literals('pwd = ("S3cr3tVal"  # half\n  "ue99xQ")') == ["S3cr3tVal", "ue99xQ"]
    assert literals(f"{'n' * 5000}_password = S3cr3tValue99x") == ["S3cr3tValue99x"]


def test_choices_and_several_names():
    lit, other = "S3cr3tValue99x!", "Zk93jfkQ02lqAB"
    for text in (
        f'pwd = ["{lit}"]', f'pwd = ("{lit}", 3)', f'pwd = [\n  "{lit}",  # first\n]', f'passwords = ["short", "{lit}"]', f'a, pwd = 1, "{lit}"', f'pwd, b = "{lit}", 2', f'{{ a, pwd := 1, "{lit}"',
        f'pwd = x or "{lit}"', f'pwd = x || "{lit}"', f'pwd = x ?? "{lit}"', f'pwd = load("n") or "{lit}"', f'pwd = os.environ["n"] or "{lit}"', f'pwd = c ? "{lit}" : d', f'pwd = c == 1 ? d : "{lit}"',
        f'pwd = f(x) ? "{lit}" : null', f'pwd = "{lit}" if c else None', f'pwd = None if c else "{lit}"', f'pwd = "%s" % "{lit}"', f'keys = ["n", "{lit}"]\nx = keys\npassword = x',
        f'base = c ? "n" : "{lit}"\nsecret = base', f'PASSPHRASE="{lit}" ./run', f'PASSPHRASE="{lit}" & ./run', f'x = [{{"password": "{lit}"}}]', f"args = [\"--password '{lit}'\"]", f'x = f(a, pwd="{lit}", n="{other}")',
        f'f(\n  a, pwd="{lit}")', f'pwd = load(secret="{lit}") or None', f"pwd = c ? d : e; f = {{'x': 1, 'token2': '{lit}'}}",
    ):
        assert literals(text) == [lit], text
    for text in (f'pwd = ["{lit}", "{other}"]', f'pwd = "{lit}" or "{other}"', f'pwd = c ? "{lit}" : "{other}"', f'a, pwd, token = 1, "{lit}", "{other}"'):
        assert literals(text) == [lit, other], text
    assert literals('pwd = ["S3cr3t", "Value9", "x!Zk93"]') == []  # each by itself is short
    for text in (f'pwd, b = load(), "{lit}"', f'a, b = "{lit}", 2\npassword = b', f'pwd = "{lit}" == x ? a : b', "password: this or abc123def456ghi"):
        assert literals(text) == [], text
    turned = 'a = "Zk93jfkQ02lq"\n' + "a = a or a\n" * 3000 + "secret = a\n"
    assert literals(turned) == ["Zk93jfkQ02lq"]


def test_scopes_and_rebinding():
    lit = "S3cr3tValue99x!"
    for text in (
        f'def a():\n    key1 = "{lit}"\n\ndef b():\n    password = key1\n', f'x = "{lit}"\nx = load()\npassword = x', f'function a() {{ const k = "{lit}"; }}\nfunction b() {{ password = k; }}',
        f'# k1 = "{lit}"\npassword = k1', f'/* k1 = "{lit}" */ password = k1', f'password = decode("{lit}")', f'key1 = "a b"\npassword = key1', "it's a secret: nobody's business", "password: [",
    ):
        assert literals(text) == [], text


def test_lexing_takes_time_in_proportion():
    import time

    for unit in ("a: ", "(", "<a ", "[x", "'", '"\\', "a = ", "x, ", "/*", "{", "k: \n", "--a ", "a=(", "```", '"\'"', "]", "f'{", "a or ", "a ? ", "x[1] or ", "['a', ", "a = f(", "a if ", "'%s' % "):
        times = []
        for n in (5_000, 20_000):
            begin = time.perf_counter()
            ss.literal_spans("secret " + unit * n + "= 1")
            times.append(time.perf_counter() - begin)
        assert times[1] < 10 * times[0] + 0.5, (unit, times)


def brute_classes(texts: dict) -> dict:
    def bag(t):
        w = tv.WORD.findall((t or "").lower())
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()

    bags = {k: bag(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = sum((bags[a] & bags[b]).values())
            if common and common >= 0.8 * (bags[a].total() + bags[b].total() - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in texts}


@needs_tables
def test_classes_like_brute_force(spark, docs):
    assert {r["doc_id"]: r["class_id"] for r in q.op4_near_dedup(spark, SMALL).collect()} == brute_classes(docs)


def test_hot_bucket_is_ranked_in_parts(spark):
    found = object.__new__(nd.NearDuplicates)
    found.threshold = nd.THRESHOLD
    rows = [(1, n, 100, 80 + n * 7 % 21, n % 5, [-1] * nd.BITMAP_LONGS) for n in range(400)]
    mixed = spark.createDataFrame(rows, "bucket long, node long, size long, shared long, component long, bits array<long>")
    best = sorted(rows, key=lambda r: (-r[3] / r[2], r[1]))[: nd.HUBS]
    want = {(min(x[1], y[1]), max(x[1], y[1])) for y in best for x in rows if x[4] != y[4] and min(x[3], y[3]) * 1.8 >= 0.8 * 200}
    assert {(r["a"], r["b"]) for r in found._to_hubs(mixed).collect()} == want


def test_hot_bucket_is_cut_into_cells(spark, monkeypatch):
    """Same pairs, each once, with one bucket in a single cell and in many."""
    found = object.__new__(nd.NearDuplicates)
    found.threshold = nd.THRESHOLD
    rng = np.random.default_rng(4)
    rows = [(int(b), n, 100, int(rng.integers(80, 101)), n % 7, rng.integers(-(2**62), 2**62, nd.BITMAP_LONGS).tolist() if n % 3 else [-1] * nd.BITMAP_LONGS) for b, k in ((1, 300), (2, 12)) for n in range(1000 * b, 1000 * b + k)]
    mixed = spark.createDataFrame(rows, "bucket long, node long, size long, shared long, component long, bits array<long>")
    take = lambda frame: sorted((r["a"], r["b"]) for r in frame.collect())
    whole = take(found._to_hubs(mixed)), take(found._all_crossing(mixed))
    monkeypatch.setattr(nd, "CELL_NODES", 40)
    assert (take(found._to_hubs(mixed)), take(found._all_crossing(mixed))) == whole
    assert len(whole[1]) == len(set(whole[1])) > 1000
    cells = found._celled(mixed, mixed.withColumnRenamed("node", "x"), mixed.withColumnRenamed("node", "y"), False)[0]
    held = [r["count"] for r in cells.groupBy("bucket", "i", "j").count().collect()]
    assert len(held) == 15 * 15 + 1 and max(held) < 60


@pytest.mark.parametrize("cell", [nd.CELL_NODES, 40])
def test_large_group_of_variants(spark, monkeypatch, cell):
    monkeypatch.setattr(nd, "CELL_NODES", cell)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(150)]
    texts = {0: " ".join(base)}
    for k in range(1, 160):
        own = list(base)
        for place in rng.choice(150, size=rng.integers(0, 9), replace=False):
            own[place] = f"v{rng.integers(10**6)}"
        texts[k] = " ".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_classes(texts)
    assert len(set(want.values())) > 20
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(frame).collect()} == want


def test_bounds_keep_pairs_at_the_threshold(spark):
    found = object.__new__(nd.NearDuplicates)
    found.threshold = nd.THRESHOLD
    sizes = [(m, n, 4 * (m + n) // 9) for m in range(1, 200) for n in range(m, min(200, 5 * m // 4 + 1)) if (m + n) % 9 == 0]
    assert all(k / (m + n - k) == 0.8 for m, n, k in sizes)
    rows = [(b, 2 * b + end, (m, n)[end], k, 2 * b + end, [0]) for b, (m, n, k) in enumerate(sizes) for end in (0, 1)]
    mixed = spark.createDataFrame(rows, "bucket long, node long, size long, shared long, component long, bits array<long>")
    assert found._all_crossing(mixed).count() == len(sizes)
    assert found._all_crossing(mixed.withColumn("shared", F.col("shared") - 1)).count() == 0


def test_signatures_are_unbiased():
    a = {i: int(w) for i, w in enumerate([1, 5, 2, 9, 1, 1, 3, 30] * 5)}
    b = {i + 7: int(w) for i, w in enumerate([2, 4, 2, 8, 1, 2, 3, 20] * 5)}
    keys = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    same = []
    for seed in range(80):
        owner = np.array([0] * len(a) + [1] * len(b))
        element = tv.mix(np.array([k + 10_000 * seed + 1 for k in [*a, *b]], np.uint64))
        s = bm.signatures(owner, element, np.array([*a.values(), *b.values()], float), 2)
        same.append((s[0] == s[1]).mean())
    assert np.mean(same) == pytest.approx(want, abs=0.015)
    assert np.isinf(bm.signatures(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0), 2)).all()


def test_alignment_like_a_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, matches, i0, i1, j0, j1 = dc.smith_waterman(a, b)
        assert score == h.max()
        assert matches <= min(i1 - i0, j1 - j0)


def test_alignment_in_little_memory(monkeypatch):
    """Tables that are made again from some of their rows give what kept ones give, of repeated words too."""
    rng = np.random.default_rng(2)
    pairs = []
    for t in range(60):
        kinds = rng.integers(2, 40)
        a, b = (rng.integers(0, kinds, rng.integers(1, 90)).astype(np.uint64) for _ in range(2))
        pairs.append((a, np.concatenate((b, np.where(rng.random(len(a)) < 0.15, 77, a).astype(np.uint64), b[:5], a[len(a) // 3 :])) if t % 2 else b))
    kept = [(dc.smith_waterman(a, b), dc.held_part(a, b)) for a, b in pairs]
    monkeypatch.setattr(dc, "CELLS", 0)
    assert kept == [(dc.smith_waterman(a, b), dc.held_part(a, b)) for a, b in pairs]
    assert sum(part is not None for _, part in kept) > 20
    item = rng.integers(0, 10**6, 5000).astype(np.uint64)
    window = np.concatenate((item[::-1], np.where(rng.random(5000) < 0.2, 10**7, item).astype(np.uint64), item[::-1]))
    tracemalloc.start()
    _, matches, _, _, start, end = dc.held_part(item, window)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert matches > 3900 and 4990 < start < end < 10_010
    assert peak < 30e6  # a table of bytes alone has 75e6


def test_edited_leaks(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"q{rng.integers(400)}"
    items = {k: [word() for _ in range(40)] for k in range(6)}
    rows, want = [], set()
    for d in range(60):
        filler = [word() for _ in range(80)]
        if d % 3 == 0:
            k = d % 6
            own = list(items[k])
            for place in rng.choice(40, size=d % 5, replace=False):
                own[place] = "edited"
            del own[10 : 10 + d % 3]
            filler[20:20] = own
            want.add((d, k))
        rows.append((d, " ".join(filler)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(frame, bench).collect()}
    assert set(got) == want
    assert got[0, 0]["score"] == 1.0
    clean = {r["doc_id"] for r in dc.without_leaks(frame, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}


def test_every_fourth_word_changed(spark):
    item = [f"w{i}" for i in range(24)]
    edited = [w if i % 4 != 3 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(["before"] * 30 + edited + ["after"] * 5)), (2, " ".join(item[:3] + ["far"] * 60 + item[10:13])), (3, " ".join(item[4:8]))]
    got = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["doc_start"]) for r in got] == [(1, 30)]
    assert 0.5 <= got[0]["score"] < 0.75


def test_pieces_and_edited_copies_in_many_texts(spark):
    item, short = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(24)]
    edited = [w if i % 4 != 3 else "other" for i, w in enumerate(short)]
    rows = [(d, " ".join([f"a{d}", *item[20:40], f"b{d}"])) for d in range(500)]
    rows += [(d, " ".join([f"a{d}", *edited, f"b{d}"])) for d in range(500, 1000)]
    rows += [(d, " ".join([f"a{d}", *item[20:25], f"b{d}"])) for d in range(1000, 1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["doc_start"], r["matches"]) for r in dc.find_leaks(frame, bench).collect())
    assert got == [(d, 1, 1, 20) for d in range(500)] + [(d, 2, 1, 18) for d in range(500, 1000)]
    assert {r["doc_id"] for r in dc.without_leaks(frame, bench).collect()} == set(range(1000, 1500))


def test_every_part_of_every_alignment_is_tested():
    item, new = [f"w{i}" for i in range(60)], [f"n{i}" for i in range(15)]
    seeds = dc.Seeds.of([1], [" ".join(item)])
    far = [f"f{i}" for i in range(200)]
    longer = item[20:32] + new[:9] + item[41:53]  # more points than 13 equal words, but 24 of 33 equal
    cases = {
        "two passages": (item[:13] + new + item[28:38], [(13, 0, 13)]),
        "passage alone": (item[:13], [(13, 0, 13)]),
        "too short": (item[:12] + new + item[28:40], []),
        "second window": (longer + far + item[:13], [(13, 233, 246)]),
        "longer alone": (longer, []),
        "second alignment": (longer + far[:4] + item[41:54], [(13, 37, 50)]),
    }
    for name, (text, want) in cases.items():
        assert [(row[4], row[5], row[6]) for row in dc.leaks(seeds, [" ".join(text)])] == want, name


def test_long_windows_are_aligned_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    item = [f"w{i}" for i in range(20)]
    stock = [w for _ in range(300) for w in (*item[:6], "and")]
    texts = [" ".join([*stock[:k], *item[:9], "other", *item[10:], *stock[k:]]) for k in rng.integers(0, len(stock), 20)]
    seeds = dc.Seeds.of([1], [" ".join(item)])
    cut = dc.leaks(seeds, texts)
    monkeypatch.setattr(dc, "PIECE", 10**6)
    assert cut == dc.leaks(seeds, texts)
    assert [row[4] for row in cut] == [19] * 20


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(12)], "item_id long, text string")
    frame = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(14)], "doc_id long, text string")
    whole = sorted(map(tuple, dc.find_leaks(frame, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, dc.find_leaks(frame, items).collect())) == whole
    assert len(whole) == 12


@needs_tables
def test_token_round_trip(spark, docs):
    with open(ts.VOCABULARY, "rb") as f:
        content = f.read()
    coder = ts.encoding(content)
    blocks, names = ts.write_streams(spark.read.parquet(f"{SMALL}/documents.parquet"), block=777)
    streams: dict[int, bytes] = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["file"], r["block"])):
        streams[r["file"]] = streams.get(r["file"], b"") + bytes(r["data"])
    rows = names.join(ts.scan_tokens(blocks), ["file", "number"]).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = np.frombuffer(streams[r["file"]], ts.TOKEN)[r["start"] : r["start"] + r["n_tokens"]]
        assert coder.decode(own.tolist()) == (docs[r["doc_id"]] or "")
        assert r["ended"]


def test_scan_of_flat_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    want = []
    for f in range(5):
        ids = rng.choice([3, 4, ts.EOD], p=[0.6, 0.3, 0.1], size=rng.integers(0, 300)).astype(ts.TOKEN)
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes())
        bounds = [-1, *np.flatnonzero(ids == ts.EOD).tolist()]
        want += [(f, k, a + 1, b - a - 1, True) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
        if bounds[-1] + 1 < len(ids):
            want.append((f, len(bounds) - 1, bounds[-1] + 1, len(ids) - bounds[-1] - 1, False))
    for block, span in ((1, 6), (7, 14), (7, 100), (1000, 10**6)):
        got = ts.scan_tokens(ts.flat_files(spark, str(tmp_path), block, span)).collect()
        assert sorted((int(r["file"].rsplit("/", 1)[1][0]), *r[1:]) for r in got) == want


def test_vocabularies_that_do_not_fit():
    with pytest.raises(ValueError, match="end-of-document id 3"):
        ts.check_vocabulary(b"YQ== 3\nYg== 4\n", 3)
    with pytest.raises(ValueError, match="do not fit"):
        ts.check_vocabulary(b"YQ== 70000\n", 3)


def test_ids_that_are_texts(spark):
    rows = [("a", "one two three four five six seven"), ("b", "one two three four five six seven"), (None, "other words than before stand here"), ("c", None)]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in nd.near_duplicates(frame).collect()) == [("None", "None"), ("a", "a"), ("b", "a"), ("c", "c")]
    items = spark.createDataFrame([("x", "two three four five six seven")], "item_id string, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(frame, items).collect()) == [("a", "x"), ("b", "x")]
    assert sorted((str(r["doc_id"]), r["n_tokens"] > 0) for r in ts.count_tokens(frame).collect()) == [("None", True), ("a", True), ("b", True), ("c", False)]


@needs_tables
def test_leaks_like_all_pairs(spark, docs):
    """Every whole text is aligned with every item, without seeds or windows."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    split = lambda t: tv.word_hashes([t])[0]
    words, wanted = {i: split(t) for i, t in items.items()}, set()
    for d, t in docs.items():
        own = split(t)
        for i, w in words.items():
            if np.isin(w, own).sum() >= min(dc.MIN_RUN, dc.MIN_SCORE * len(w)) and dc.held_part(w, own) is not None:
                wanted.add((d, i))
    found = {(r["doc_id"], r["item_id"]) for r in q.op3_decontaminate(spark, SMALL).collect()}
    assert wanted
    assert found <= wanted
    assert len(found) >= 0.95 * len(wanted)


@needs_tables
def test_language_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in q.op10_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_repeated_rows_are_learned_once(spark, monkeypatch):
    rows = [(0, "the same words", "en")] * 2000 + [(i, f"word{i} and others", "en") for i in range(1, 1500)] + [(i, f"mot{i} et autres", "fr") for i in range(1500, 1900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(li.Tagger, "train", classmethod(lambda cls, samples, seed=7: samples))
    samples = Counter(li.train_tagger(frame))
    assert samples["en", "the same words"] <= 1
    assert samples["fr", "mot et autres"] == 200
    assert samples["en", "word and others"] > 60


def test_letters_beside_other_signs():
    tagger = li.Tagger(["en"], np.zeros((1 << li.BITS, 1), np.float32), np.zeros((1, 1)))
    assert tagger.predict(["x\u00b2", "\u00b2 \u00b3", "12", "", None])[0] == ["en", *[li.UNKNOWN] * 4]


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(8)
    words = [["".join(chr(0x4E00 + 40 * k + int(c)) for c in rng.integers(0, 40, 4)) for _ in range(30)] for k in range(70)]
    rows = [(f"l{k}", " ".join(rng.choice(words[k], 30))) for k in range(70) for _ in range(20 if k < 64 else 10)]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    tagger = li.train_tagger(frame)
    assert len(tagger.languages) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify(frame, tagger).collect()}
    assert all(np.mean([got[i] == own for i, (own, _) in enumerate(rows) if own == f"l{k}"]) > 0.8 for k in range(70))


def test_forward_backward_like_all_paths():
    rng = np.random.default_rng(0)
    steps, labels = 4, 3
    e, t = rng.random((steps, 1, labels)) + 0.1, rng.random((labels, labels)) + 0.1
    total, marginal, moves = 0.0, np.zeros((steps, labels)), np.zeros((labels, labels))
    for path in np.ndindex(*[labels] * steps):
        p = np.prod([e[i, 0, k] for i, k in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += p
        for i, k in enumerate(path):
            marginal[i, k] += p
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += p
    m, x = li.forward_backward(e, t, np.array([steps]))
    assert np.allclose(m[:, 0], marginal / total)
    assert np.allclose(x, moves / total)


def test_chains_run_on(monkeypatch):
    left = [" ".join(f"{a}{b}ing" for a in "abcdefgh" for b in "lmnop")] * 20
    right = [" ".join(f"{a}{b}ung" for a in "rstuvwxy" for b in "eioäü")] * 20
    tagger = li.Tagger.train([("left", t) for t in left] + [("right", t) for t in right])
    rng = np.random.default_rng(4)
    texts = [[str(w) for w in rng.choice(["aling", "bming", "reung", "siung", "mixed", "words"], n)] for n in (700, 1, 256, 257, 40, 513)]
    cut = tagger.posteriors(texts)
    monkeypatch.setattr(li, "CHAIN", 10**6)
    for a, b in zip(cut, tagger.posteriors(texts), strict=True):
        assert np.allclose(a, b, rtol=0, atol=1e-12)


@pytest.mark.parametrize("chain", [1, 7, 64])
def test_messages_go_as_far_as_it_takes(monkeypatch, chain):
    """Words that no language prefers carry what stands before and after them over any number of chains."""
    rng = np.random.default_rng(6)
    tagger = li.Tagger(["a", "b", "c"], np.zeros((1 << li.BITS, 3), np.float32), np.log(np.array([[0.999, 0.0005, 0.0005], [0.0004, 0.9991, 0.0005], [0.001, 0.001, 0.998]])))
    monkeypatch.setattr(li.Tagger, "emissions", lambda self, words: np.array([{"l": [9, 0, 0], "r": [0, 9, 0], "n": [0, 0, 0]}[w] for w in words], np.float32))
    texts = [["l"] + ["n"] * 300 + ["r"], ["n"] * 150, ["r"], [], [str(w) for w in rng.choice(list("lrn"), 400, p=[0.01, 0.01, 0.98])]]
    monkeypatch.setattr(li, "CHAIN", 10**6)
    whole = tagger.posteriors(texts)
    monkeypatch.setattr(li, "CHAIN", chain)
    for a, b in zip(tagger.posteriors(texts), whole, strict=True):
        assert np.allclose(a, b, rtol=0, atol=1e-12)
    assert whole[0][1, 0] > 0.99 > whole[0][150, 0] > 0.3


def test_all_words_of_a_text_are_learned(spark, monkeypatch):
    words = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(10_000)]
    rows = [(1, " ".join(words), "a"), *[(i, f"mot{i}", "b") for i in range(2, 60)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(li.Tagger, "train", classmethod(lambda cls, samples, seed=7: samples))
    assert dict(li.train_tagger(frame.limit(1)))["a"] == " ".join(words)
    monkeypatch.setattr(li, "TOTAL_BYTES", 100)  # a language of long texts still has one, whole
    samples = li.train_tagger(frame)
    assert [t for lang, t in samples if lang == "a"] == [" ".join(words)]
    assert 0 < sum(lang == "b" for lang, _ in samples) <= 50 // 4


def test_code_switched_words():
    left = [" ".join(f"{a}{b}ing" for a in "abcdefgh" for b in "lmnop")] * 20
    right = [" ".join(f"{a}{b}ung" for a in "rstuvwxy" for b in "eioäü")] * 20
    tagger = li.Tagger.train([("left", t) for t in left] + [("right", t) for t in right])
    mixed = "aling bming cning " * 4 + "reung siung toung " * 4
    tags = [lang for *_, lang, _ in li.label_words(tagger, mixed)]
    assert tags == ["left"] * 12 + ["right"] * 12
    assert tagger.predict(["", None, "12 !!", "²½"])[0] == ["und"] * 4


@needs_tables
def test_quality_accuracy(spark):
    where = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    rows = [r for r in q.op5_quality(spark, where).collect() if r["held_out"] and r["doc_id"] in marks]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in rows]) > 0.93
    good, bad = ([r["score"] for r in rows if marks[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_risk_like_a_direct_sum():
    rng = np.random.default_rng(3)
    branches = set()
    for prior in (0.2, 0.5, 0.9):
        for shift in (-2.0, 0.0, 2.0):
            fp, fu = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 11)

            def parts(fp, fu, prior=prior):
                positive = prior * np.mean(np.log1p(np.exp(-fp)))
                return positive, np.mean(np.log1p(np.exp(fu))) - prior * np.mean(np.log1p(np.exp(fp)))

            negative = parts(fp, fu)[1] < 0
            branches.add(bool(negative))
            risk = (lambda a, b: -parts(a, b)[1]) if negative else (lambda a, b: sum(parts(a, b)))
            up, uu = qu.risk_slope(fp, fu, prior)
            for own, slope, at in ((fp, up, 0), (fu, uu, 1)):
                for k in range(len(own)):
                    step = np.zeros(len(own))
                    step[k] = 1e-6
                    more, less = ([fp, fu], [fp, fu])
                    more, less = list(more), list(less)
                    more[at], less[at] = own + step, own - step
                    assert slope[k] == pytest.approx((risk(*more) - risk(*less)) / 2e-6, abs=1e-6)
    assert branches == {True, False}


@pytest.mark.parametrize("equal", [True, False])
def test_id_with_most_rows_leaves_room_for_others(spark, monkeypatch, equal):
    monkeypatch.setattr(qu, "POSITIVE_ROWS", 50)
    monkeypatch.setattr(qu, "UNLABELLED_ROWS", 100)
    monkeypatch.setattr(qu, "train_scorer", lambda p, u: (p, u))
    hot = [(1, "same" if equal else "same" * (i % 9 + 1) + f"{i}") for i in range(3000)]
    frame = spark.createDataFrame([*hot, *((i, f"text {'x' * (i % 50)}") for i in range(2, 1002))], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(1, 41)], "doc_id long, quality int")
    p, u = qu.train_on(frame, marks)
    ids = [i for i in range(1, 41) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(p) == len(ids)
    assert (15 if equal else 70) < len(u) <= 100
    if equal:
        assert (u == qu.features("same")).all(axis=1).sum() <= 1


@needs_tables
def test_zeros_are_never_read(spark):
    docs_, labels_ = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    whole, ones = qu.train_on(docs_, labels_), qu.train_on(docs_, labels_.filter("quality = 1"))
    assert whole.prior == ones.prior
    assert all(np.array_equal(a, b) for x, y in zip(whole.models, ones.models, strict=True) for a, b in zip(x, y, strict=True))


def test_prior_from_positives_alone():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(4, 1, (600, 4))
    u = np.concatenate((good[:1400], bad))
    assert qu.estimate_prior(good[1400:], u) == pytest.approx(0.7, abs=0.1)
    padded = lambda x: np.pad(x, ((0, 0), (0, qu.WIDTH - 4)))
    scorer = qu.train_scorer(padded(good[1400:]), padded(u))
    assert (scorer.scores(padded(good[:500])) >= qu.CUT).mean() > 0.9
    assert (scorer.scores(padded(bad[:500])) < qu.CUT).mean() > 0.9
