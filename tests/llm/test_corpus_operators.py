"""HTML extraction, mixing, suffix dedup, fixity, SimHash and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

import corpus_pipeline
from tallyforge.llm import html_extraction, induced_sort, mixing, oracles, queries, simhash, suffix_dedup, warc_fixity
from tallyforge.llm.common import checkpointed, table

SF = "/root/testdata/sf0.001"


def test_html_text():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">Cookies</div><div id=sidebar><p>side</p></div>
<main><h1>Title &amp; more</h1><p>One<p>Two <b>bold</b>&nbsp;x<br>y<form><p>sign</p></form><pre>a
 b</pre><ul><li>i<li>j</ul><div class="comments"><p>c1</p></div><table><tr><td>a</td><td>b</td></tr></table></main><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""
    assert html_extraction.main_text(page) == "Title & more\nOne\nTwo bold x y\na b\ni\nj\na\nb"
    for odd in (None, "", "<", "<p", "</p></div>", "a<b>c", "<!-- x", "<script>never closed", "<p>" * 3000 + "deep"):
        assert isinstance(html_extraction.main_text(odd), str)
    assert html_extraction.main_text("plain text") == "plain text"


def test_class_words_lose_no_article():
    text = html_extraction.main_text
    for frame in ('<body class="no-sidebar">{}</body>', '<body class="search">{}</body>', '<html class="nav"><body>{}</body></html>', '<div class="content with-sidebar">{}</div>', '<div class="sticky-header">{}</div>', '<div class="widget">{}</div>', '<main class="related">{}</main>'):
        for inner in ("<article><p>The story.</p></article>", '<article class="post share-open"><p>The story.</p></article>'):
            assert text(frame.format(inner) + "<p>x</p>") == "The story.", frame
    assert text('<body class="no-sidebar"><div class="sticky-header">The story.</div></body>') == "The story."
    for comment in ('<article class="comment">Mine.</article>', '<article id="div-comment-7" class="comment-body">Mine.</article>'):
        assert text(f"<div>The story.</div>{comment}") == "The story."
        assert text(f"<div>By us</div><article>The story.</article><div class=comments>{comment}{comment}</div>") == "The story."
    assert text("<div>The long story of this page.</div><div class=related><article>Other</article></div>") == "The long story of this page."


def pages(spark, n=30):
    notice = "<section><p>We store small files on your device.</p></section>"
    rows = [(i, f"http://Host.example/{i}", f"<html><body>{notice}<article><h1>Story {i}</h1><p>Text of story {i}.</p><p>Er.</p></article><section>Unique {i}</section></body></html>") for i in range(n)]
    rows += [(n, "http://other.example/a", f"<body>{notice}<p>Kept here</p></body>"), (n + 1, None, "<p>No host</p>"), (n + 2, "http://x.example", None), (n + 3, "http://x.example", ""), (n, "http://other.example/a", f"<body>{notice}<p>Kept here</p></body>")]
    rows += [(1000 + i, f"http://flat.example/{i}", f"<body>{notice}<p>Own words {i}</p></body>") for i in range(8)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")


def test_site_templates(spark):
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(pages(spark)).collect()}
    joined = {r["page_id"]: r["text"] for r in html_extraction.extracted(pages(spark), broadcast_rows=-1).collect()}
    assert got == joined
    assert got[3] == "Story 3\nText of story 3.\nEr."
    assert got[30] == "We store small files on your device.\nKept here"  # too few pages to tell
    assert got[1002] == "Own words 2"
    assert (got[31], got[32], got[33]) == ("No host", "", "")
    assert html_extraction.extracted(pages(spark).limit(0)).count() == 0


def test_templates_of_large_hosts_and_in_paragraphs(spark):
    """A menu on a fifth of a host's pages, and a notice as a paragraph of its articles; an article that many pages repeat stays."""
    menu = "<div><a href=/a>News of the whole region</a></div>"
    notice = "<p>Write to us if you have seen anything.</p>"
    rows = [(i, f"http://big.example/{i}", f"<body>{menu if i % 5 == 0 else ''}<div>Story {i} is told here at length.</div></body>") for i in range(600)]
    rows += [(1000 + i, f"http://par.example/{i}", f"<body><article><p>Story {i} is told here.</p>{notice}<p>Er.</p></article></body>") for i in range(20)]
    rows += [(2000 + i, f"http://copy.example/{i}", f"<body><article><p>The one story told here again.</p></article><i>{i}</i></body>") for i in range(150)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(frame).collect()}
    assert got == {r["page_id"]: r["text"] for r in html_extraction.extracted(frame, broadcast_rows=-1).collect()}
    assert all(got[i] == f"Story {i} is told here at length." for i in range(600))
    assert all(got[1000 + i] == f"Story {i} is told here.\nEr." for i in range(20))
    assert all(got[2000 + i] == "The one story told here again." for i in range(150))


def test_templates_decide_where_no_tag_or_name_tells(spark):
    """Pages of plain div elements: menus, rotating notices and a legal line recur, stories do not. Held against subtrees counted by a parser of the standard library."""
    from collections import Counter
    from html.parser import HTMLParser

    rng = np.random.default_rng(4)
    words = lambda k: " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(k))
    menu, legal, turning = words(7), words(12), [words(9) for _ in range(12)]
    rows, stories = [], {}
    for i in range(240):
        stories[i] = [words(int(rng.integers(12, 40))) for _ in range(int(rng.integers(1, 4)))]
        blocks = [menu, turning[int(rng.integers(12))], *stories[i], legal]
        rows.append((i, "http://plain.example/x", "<html><body>" + "".join(f"<div><span>{b}</span></div>" for b in blocks) + f"<script>n={i}</script></body></html>"))
    rows += [(1000 + i, f"http://twin.example/{i}", f"<body><div>{menu} {legal}</div><div>{words(3)}</div></body>") for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extraction.extracted(frame).collect()}
    plain = {r["page_id"]: r["text"] for r in html_extraction.extracted(frame, share=2.0, least=10**6, rotating=2.0).collect()}

    class Blocks(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.found = []
            self.feed(html)

        def handle_data(self, data):
            self.found.append(data)

    counts = Counter(b for i, _, h in rows[:240] for b in set(Blocks(h).found))
    for i, _, h in rows[:240]:
        kept = [b for b in Blocks(h).found if counts[b] < 5]
        assert got[i]["text"] == "\n".join(b for b in kept if not b.startswith("n=")) == "\n".join(stories[i])
        assert got[i]["n_template_words"] == 7 + 9 + 12 and plain[i] != got[i]["text"]
    assert all(got[1000 + i]["text"].count(" ") == 2 for i in range(20))
    again = {r["page_id"]: (r["text"], r["n_template_words"]) for r in html_extraction.extracted(frame, broadcast_rows=-1).collect()}
    assert again == {i: (r["text"], r["n_template_words"]) for i, r in got.items()}


def test_rotating_variants_spare_copies_of_a_story(spark):
    """A story told on eight pages of a host, none of which is a copy byte by byte, stays whole."""
    rows = [(i, "http://h.example/", f"<body><div>page number {i} of many</div><div>The one story that eight pages tell in full</div><script>{i}</script></body>") for i in range(8)]
    rows += [(100 + i, "http://h.example/", f"<body><div>Story {i} is told here and nowhere else at all</div></body>") for i in range(200)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("The one story" in got[i] for i in range(8)) and all(got[100 + i].startswith(f"Story {i} ") for i in range(200))


def test_running_text_that_recurs_stays(spark):
    """A sentence in a hundredth and in 29 of 100 articles of a host of 2,000 pages, with article tags and without; what is on half of them goes."""
    often, seldom, half = "This sentence stands in many stories of the host.", "This one is told in a few stories alone.", "Half of all pages end with these very words."
    rows = []
    for host, (a, b) in {"tagged": ("<article>", "</article>"), "bare": ("<div>", "</div>")}.items():
        for i in range(2000):
            body = [f"Story {i} of {host} begins here."] + [often] * (i % 100 < 29) + [seldom] * (i % 100 == 50) + [f"So ends story {i}."] + [half] * (i % 2)
            rows.append((len(rows), f"http://{host}.example/{i}", f"<body><div>The menu of {host} has five words</div>{a}" + "".join(f"<p>{x}</p>" for x in body) + f"{b}</body>", body[: len(body) - i % 2]))
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(body) for i, _, _, body in rows)


def test_broken_markup_and_article_headers():
    text = html_extraction.main_text
    assert text('<p class="x>One</p><p>Two</p>') == "One\nTwo"
    assert text("<body><header>Site</header><article><header><h1>Title</h1></header><p>Body</p><header>by line</header></article></body>") == "Title\nBody"
    long = "<div>" + "<p>many words here</p>" * 50_000 + "</div>"
    assert text(long).count("\n") == 49_999


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h.example/", "<body><div>The whole story</div></body>") for i in range(40)]
    got = html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {"The whole story"}


def test_mixing_meets_its_marginals(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    cells = checkpointed(mixing.weighted(docs, mixing.TARGETS).groupBy("g_source", "g_lang", "g_topic").agg(mixing.F.sum("n_tokens").alias("n")).filter("n > 0").coalesce(1))
    w = mixing.raked(cells, mixing.TARGETS).toPandas()
    for d in mixing.DIMENSIONS:
        have = w.groupby(f"g_{d}")["w"].sum()
        aim = {k: v for k, v in mixing.TARGETS[d].items() if k in have.index}
        assert all(abs(have[k] - v / sum(aim.values())) < 1e-8 for k, v in aim.items())
    p = mixing.probabilities(mixing.raked(cells, mixing.TARGETS), 0.5).toPandas()
    assert p["p"].between(0, 1).all() and abs((p["p"] * p["n"]).sum() / p["n"].sum() - 0.5) < 0.05


def test_mixing_of_targets_that_contradict_each_other(spark):
    """Every English document is from one source, which may have less than English must: sweeps stop where the error no longer falls. A marginal met at once ends them at once."""
    rows = [("a", "en", "prose", 50), ("b", "de", "prose", 50), ("b", "fr", "legal", 10)]
    cells = spark.createDataFrame(rows, "g_source string, g_lang string, g_topic string, n long").coalesce(1)
    hard = {"source": {"a": 0.2, "b": 0.8}, "lang": {"en": 0.7, "de": 0.2, "fr": 0.1}, "topic": {"prose": 0.9, "legal": 0.1}}
    assert mixing.raked(cells, hard).count() == 3
    easy = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.4, "fr": 0.1}, "topic": {"prose": 0.9, "legal": 0.1}}
    w = {r["g_lang"]: r["w"] for r in mixing.raked(cells, easy).collect()}
    assert abs(w["en"] - 0.5) < 1e-9 and abs(w["fr"] - 0.1) < 1e-9


def test_mixing_edges(spark, docs, empty):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["probability"] <= 1 for r in got)
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs.filter("text is null")).filter("sampled").count() == 0


def brute_dedup(rows):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, docs, empty):
    want = brute_dedup([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()), key=str) == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_on_short_repeats(spark):
    """Repeats of 45 to 60 bytes within noise and runs of one letter: all the work falls to the suffix order."""
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("ab "), 60)) for _ in range(12)]
    texts = ["".join("".join(rng.choice(list("abc"), int(rng.integers(0, 9)))) + parts[rng.integers(12)][: int(rng.integers(45, 61))] for _ in range(6)) for _ in range(60)]
    texts += ["z" * int(n) for n in rng.integers(40, 130, 10)]
    rows = list(enumerate(texts))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_dedup(rows)


def test_induced_order():
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = np.append(rng.integers(0, int(rng.integers(2, 5)), int(rng.integers(1, 120))), 0)
        depth = int(rng.integers(3, 20))
        at, lcp = (np.concatenate(x) for x in zip(*induced_sort.suffix_order(text, depth, int(rng.integers(1, 9)), int(rng.integers(1, 9))), strict=True))
        assert sorted(at.tolist()) == list(range(len(text)))
        keys = [bytes(text[i : i + depth].astype(np.uint8)).partition(b"\0")[0] for i in at]
        assert keys == sorted(keys)
        for j in range(1, len(at)):
            a, b = keys[j - 1], keys[j]
            assert lcp[j] == next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def test_fixity(spark):
    rows = [(f, i, f * 100 + i, f"record {f} {i}", f"record {f} {i}" if (f, i) not in {(1, 3), (1, 17), (2, 0)} else ("damage" if i else None)) for f in range(4) for i in range(40 if f else 1)]
    got = {r["file"]: r for r in warc_fixity.audit(spark.createDataFrame(rows, "file long, seq long, record_id long, record_a string, record_b string")).collect()}
    assert {f: r["corrupt_ids"] for f, r in got.items()} == {0: "", 1: "103,117", 2: "200", 3: ""}
    assert got[0]["n_nodes_compared"] == 1 and got[0]["root_a"] == got[0]["root_b"] and got[1]["root_a"] != got[1]["root_b"]
    assert warc_fixity.audit(spark.createDataFrame(rows, "file long, seq long, record_id long, record_a string, record_b string").limit(0)).count() == 0


def test_fixity_of_large_files_and_of_repeated_positions(spark):
    bad = {3, 700, 4999}
    rows = [(0, i, i, f"record {i}", "damage" if i in bad else f"record {i}") for i in range(5000)] + [(1, 0, 8, "x", "x"), (1, 0, 9, "x", "y")]
    got = {r["file"]: r for r in warc_fixity.audit(spark.createDataFrame(rows, "file long, seq long, record_id long, record_a string, record_b string")).collect()}
    assert len(got) == 2 and got[0]["corrupt_ids"] == "3,700,4999" and got[0]["n_corrupt"] == 3 and got[0]["n_records"] == 5000
    assert got[1]["corrupt_ids"] == "9" and got[1]["n_corrupt"] == 1


def test_fixity_of_any_number_of_records(spark):
    """Files of 1, 16, 257 and 70,000 records: one row a file. Lost is not empty, and files that one replica lacks are told."""
    sizes, bad = {"one": 1, "sixteen": 16, "more": 257, "large": 70_000}, {("sixteen", 15), ("more", 256), ("large", 0), ("large", 69_999)}
    every = spark.createDataFrame([(f, n) for f, n in sizes.items()], "file string, n int").select("file", mixing.F.explode(mixing.F.sequence(mixing.F.lit(0), mixing.F.col("n") - 1)).alias("seq"))
    a = every.select("file", "seq", mixing.F.col("seq").alias("record_id"), mixing.F.concat("file", mixing.F.lit(" "), "seq").alias("record"))
    is_bad = mixing.F.lit(False)
    for f, i in bad:
        is_bad = is_bad | ((mixing.F.col("file") == f) & (mixing.F.col("seq") == i))
    b = a.withColumn("record", mixing.F.when(is_bad, mixing.F.lit("damage")).otherwise(mixing.F.col("record")))
    only = spark.createDataFrame([("only b", 0, 1, "x"), (None, 0, 2, "x"), ("one", None, 3, "x")], "file string, seq int, record_id int, record string")
    got = {r["file"]: r for r in warc_fixity.audit_replicas(a, b.unionByName(only)).collect()}
    assert {f: (r["n_records"], r["n_corrupt"], r["corrupt_ids"]) for f, r in got.items()} == {"one": (1, 0, ""), "sixteen": (16, 1, "15"), "more": (257, 1, "256"), "large": (70_000, 2, "0,69999"), "only b": (0, 1, "1")}
    assert got["only b"]["root_a"] is None and got["one"]["n_nodes_compared"] == 1 and got["large"]["n_nodes_compared"] < 200
    rows = [("f", 0, 1, "x", ""), ("f", 1, 2, "", None), ("f", 2, 3, "", ""), ("f", 2, 3, "y", "y"), ("f", 2, 4, "t", "u"), ("f", 3, None, "v", "w")]
    pairs = spark.createDataFrame([(*r, "extra") for r in rows], "file string, seq long, record_id long, record_a string, record_b string, hash string")
    assert warc_fixity.audit(pairs).first()["n_corrupt"] == 4


def test_fixity_of_warc_files(spark, tmp_path):
    """Records written to WARC files, read back in small splits with their offsets, and audited after bytes changed on the disk."""
    import glob
    import shutil

    rows = [(f, i, f"http://h.example/{f}/{i}", "body é " * int(1 + (f * 7 + i) % 9) + str(i)) for f in range(3) for i in range(40 + f)]
    made = spark.createDataFrame(rows, "file long, seq long, url string, html string").select("file", "seq", warc_fixity.warc_record(mixing.F.col("url"), mixing.F.col("html")).alias("record"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc_fixity.write_warc(made, a)
    read = warc_fixity.read_warc(spark, a, 700)
    number = mixing.F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("file")
    back = read.select(number, "seq", "offset", "n_bytes", "record_id", mixing.F.decode("record", "UTF-8").alias("record")).collect()
    want = {(r["file"], r["seq"]): r["record"] for r in made.collect()}
    assert {(r["file"], r["seq"]): r["record"] for r in back} == want and len(back) == len(want)
    disk = {f: open(glob.glob(f"{a}/file={f}/*.txt")[0], "rb").read() for f in range(3)}
    for r in back:
        assert disk[r["file"]][r["offset"] : r["offset"] + r["n_bytes"]].decode() == r["record"] and r["record_id"] == f"http://h.example/{r['file']}/{r['seq']}"
    sums = warc_fixity.with_offsets(read.select(number, "seq", "n_bytes", "record_id"), 8).collect()
    assert {(r["file"], r["seq"]): r["offset"] for r in sums} == {(r["file"], r["seq"]): r["offset"] for r in back}
    shutil.copytree(a, b)
    path, at = glob.glob(f"{b}/file=1/*.txt")[0], next(r["offset"] + r["n_bytes"] - 6 for r in back if (r["file"], r["seq"]) == (1, 33))
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"#")
    for name in glob.glob(f"{b}/file=1/.*.crc"):
        shutil.move(name, str(tmp_path / "crc"))
    again = warc_fixity.read_warc(spark, b, 700)
    got = {r["file"]: r["corrupt_ids"] for r in warc_fixity.audit_replicas(read.withColumn("file", number), again.withColumn("file", number)).collect()}
    assert got == {0: "", 1: "http://h.example/1/33", 2: ""}


def test_a_lost_record_is_one_lost_record(spark, tmp_path):
    """Replicas in two folders, 300 records in two files: one left out, one put in, one changed, one repeated; and a file that one lacks."""
    rows = [(f, i, f"http://h.example/{f}/{i}", f"body {f} {i} " * (1 + i % 5)) for f in range(2) for i in range(300)]
    made = lambda rows: spark.createDataFrame(rows, "file long, seq long, url string, html string").select("file", "seq", warc_fixity.warc_record(mixing.F.col("url"), mixing.F.col("html")).alias("record"))

    def audited(name, second):
        for side, x in (("a", rows), ("b", second)):
            for f in {r[0] for r in x}:
                folder = tmp_path / name / side / f"file={f}"
                folder.mkdir(parents=True)
                (folder / "part.warc").write_bytes("".join(r["record"] for r in made([r for r in x if r[0] == f]).orderBy("seq").collect()).encode())
            (tmp_path / name / side / "file=9").mkdir()
            (tmp_path / name / side / "file=9" / "empty.warc").touch()
        a, b = (warc_fixity.read_warc(spark, str(tmp_path / name / side), 5000) for side in "ab")
        return {r["file"][5]: r for r in warc_fixity.audit_files(a, b).collect()}

    for lost in (0, 150, 299):
        got = audited(f"lost{lost}", [r for r in rows if r[:2] != (0, lost)])
        assert {f: (r["n_corrupt"], r["corrupt_ids"]) for f, r in got.items()} == {"0": (1, f"http://h.example/0/{lost}"), "1": (0, "")}
        assert got["0"]["n_records"] == 300 and got["1"]["n_nodes_compared"] == 1 and got["0"]["n_nodes_compared"] < 150
    more = sorted([r if r[:2] != (1, 40) else (*r[:3], "changed") for r in rows] + [(0, 7, "http://h.example/new", "x"), rows[90]])
    got = audited("more", more)
    assert {f: (r["n_corrupt"], r["corrupt_ids"]) for f, r in got.items()} == {"0": (2, "http://h.example/new,http://h.example/0/90"), "1": (1, "http://h.example/1/40")}
    got = audited("less", [r for r in rows if r[0] == 0])
    assert got["1"]["n_corrupt"] == 300 and got["1"]["root_b"] is None and got["0"]["n_corrupt"] == 0


def brute_print(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if bin(p ^ q).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def test_simhash(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    want = brute_components([(d, brute_print(t)) for d, t in rows])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{brute_print(texts[r['doc_id']]):016x}" and r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 20)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    monkeypatch.setattr(simhash, "FIT_ROWS", 300)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150).tolist()
    prints = [p ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for p in base for _ in range(5)]
    distinct = sorted(set(prints))
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(distinct)], "node long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame, len(distinct))).collect()}
    want = brute_components(list(enumerate(distinct)))
    assert {d: found.get(d, d) for d in want} == want


def test_components_raise_rather_than_stop(spark):
    import pytest

    with pytest.raises(RuntimeError, match="settled"):
        simhash.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), 2)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and got[103] == got[101] == 100 and 100 not in got


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, SF)
        assert after.count() <= kept.count()
        if name != "mixing":
            assert after.columns == list(corpus_pipeline.COLUMNS)
            kept = after.cache()
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in run} <= ids and len(run) > 20
    assert not any(re.search(r"token = \"[0-9a-f]{32}", r["text"]) for r in run)


def test_pipeline_against_a_plain_version(spark):
    """Every stage of a run over the smallest documents, each held against plain Python on what the stage before it kept."""
    import zlib

    from test_text_operators import base_spans, brute_hits

    from tallyforge.llm import quality_classifier, secret_scan

    docs, labels = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS), table(spark, SF, "labels")
    rows = lambda df: sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()), key=str)
    at, kept = docs, rows(docs)
    # Quality: fitted on the labelled ones outside the held-out fold, in the order of their ids; scored one by one.
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    fit = sorted((d, t) for d, t, *_ in kept if d in quality and zlib.crc32(str(d).encode()) % 5)
    forest = quality_classifier.fitted(np.array([quality_classifier.statistics(t) for _, t in fit]), np.array([float(quality[d]) for d, _ in fit]))
    want = [r for r in kept if forest.score(np.array([quality_classifier.statistics(r[1])]))[0] >= 0.3]
    at = corpus_pipeline.quality_stage(spark, at, SF).cache()
    assert rows(at) == want and len(want) < len(kept)
    # Near duplicates: the smallest id of each component of all pairs.
    component = brute_components([(d, brute_print(t)) for d, t, *_ in want])
    want = [r for r in want if component[r[0]] == r[0]]
    at = corpus_pipeline.dedup_stage(spark, at, SF).cache()
    assert rows(at) == want
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = [r for r in want if not brute_hits(r[1], items)[1]]
    at = corpus_pipeline.decontamination_stage(spark, at, SF).cache()
    assert rows(at) == want
    # Secrets: what the base patterns find is gone; texts without any finding stay as they are.
    net = secret_scan.trained(secret_scan.labelled_findings(at))
    plain = []
    for d, t, lang, source, n in want:
        spans = secret_scan.scan([t], net)[0]
        assert set(filter(None, base_spans(t).split(","))) <= {f"{k}:{a}:{b}" for a, b, k, _ in spans}
        out, end = "", 0
        for a, b, *_ in spans:
            out, end = (out + t[end:a] + "[SECRET]" if a >= end else out), max(end, b)
        out += t[end:]
        plain.append((d, out, lang, source, len(out) if spans else n))
    at = corpus_pipeline.secrets_stage(spark, at, SF).cache()
    assert rows(at) == sorted(plain, key=str)
    # Mixing: proportional fitting over a dictionary of cells.
    cell = {}
    for d, t, lang, source, _ in plain:
        topic = next((n for n, p in mixing.TOPICS.items() if re.search(p, t)), "prose")
        known = lambda v, dim: v if v in mixing.TARGETS[dim] and v != mixing.REST else mixing.REST
        cell[d] = (known(source, "source"), known(lang, "lang"), topic), len(re.findall(r"[^\x20\x09-\x0D]+", t))
    n = {}
    for c, k in cell.values():
        n[c] = n.get(c, 0) + k
    n = {c: k for c, k in n.items() if k}
    w = {c: float(k) for c, k in n.items()}
    for _ in range(400):
        for i, dim in enumerate(mixing.DIMENSIONS):
            have, aim = {}, {c[i]: mixing.TARGETS[dim][c[i]] for c in w}
            for c, v in w.items():
                have[c[i]] = have.get(c[i], 0.0) + v
            w = {c: v * aim[c[i]] / sum(aim.values()) / have[c[i]] for c, v in w.items()}
    total, scale = mixing.BUDGET * sum(n.values()), None
    full = set()
    while True:
        scale = (total - sum(n[c] for c in full)) / (sum(v for c, v in w.items() if c not in full) or 1.0)
        more = {c for c in w if scale * w[c] / n[c] >= 1}
        if more == full or len(more) == len(w):
            break
        full = more
    p = {c: min(1.0, scale * w[c] / n[c]) for c in w}
    draw = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) / (1 << 52)
    # Targets of so few documents contradict each other, where two ways of stopping differ a little.
    last = {r["doc_id"]: r["probability"] for r in corpus_pipeline.mixing_stage(spark, at, SF).collect()}
    assert all(abs(q - p[cell[d][0]]) < 0.01 for d, q in last.items())
    assert all((d in last) == (draw(d) < p.get(c, 0.0)) for d, (c, _) in cell.items() if abs(draw(d) - p.get(c, 0.0)) > 0.01)


def test_clashing_columns(spark, docs):
    """Columns that the results would be called are replaced; a repeated seq and null files in an audit have a defined result."""
    clash = docs.selectExpr("*", "1 AS topic", "2 AS n_tokens", "3 AS probability", "4 AS sampled", "5 AS p", "6 AS g_lang")
    got = mixing.mixed(clash)
    assert got.columns.count("topic") == 1 and dict(got.dtypes)["topic"] == "string" and got.count() == docs.count()
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs.selectExpr("*", "1 AS spans", "2 AS redacted", "3 AS _key", "4 AS fp", "5 AS component"), SF)
        assert out.columns[:5] == list(corpus_pipeline.COLUMNS) and out.count() <= docs.count(), name
    few = docs.select(*corpus_pipeline.COLUMNS).filter("doc_id is null or text is null or doc_id < 6")
    assert corpus_pipeline.quality_stage(spark, few, SF).count() <= few.count()


def test_pipeline_edges(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(*corpus_pipeline.COLUMNS), SF).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() <= docs.count()


def test_pipeline_keeps_one_row_a_component(spark, docs):
    """Repeated rows, an id with two texts, null ids; held against brute-force components of the fingerprints."""
    a, b, c = (f"{w} is told " * 3 + f"in the words of {w} and of no one else" for w in ("alpha", "bravo", "charlie"))
    rows = [(1, a), (1, a), (5, c), (5, b), (2, b), (None, a), (None, "only here without an id"), (None, "only here without an id"), (7, "seven words"), (7, "other things altogether here")]
    more = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (more, docs.select(*corpus_pipeline.COLUMNS)):
        every = [(r["doc_id"], r["text"]) for r in frame.collect()]
        component = brute_components([(p, p) for p in {brute_print(t) for _, t in every}])
        kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, frame, SF).collect()]
        of = lambda t: component[brute_print(t)]  # noqa: E731,B023
        assert sorted(of(t) for _, t in kept) == sorted({of(t) for _, t in every})
        for d, t in kept:
            ids = [x for x, y in every if of(y) == of(t) and x is not None]
            assert (d, t) in every and d == min(ids, default=None)


def test_queries_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracles.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        shown = lambda x: sorted(tuple(str(v) for v in r) for r in x[columns].astype(object).where(x[columns].notna(), None).values.tolist())  # noqa: E731,B023
        assert shown(got) == shown(want), name


def test_content_hashes_tell_surroundings_apart():
    """One 24-byte phrase in 500,000 surroundings: no two wholes are equal, and equal bytes hash alike wherever they stand."""
    rng = np.random.default_rng(9)
    phrase, n = np.frombuffer(b"a phrase of 24 bytes, so", np.uint8), 500_000
    rows = rng.integers(97, 123, (n, 70), dtype=np.uint8)
    rows[:, 23:47] = phrase
    seen = set()
    for i in range(0, n, 20_000):
        part = rows[i : i + 20_000].ravel()
        a = np.arange(0, len(part), 70)
        x, y = suffix_dedup.content_hashes(part, a, a + 70)
        seen |= set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(seen) == len(np.unique(rows, axis=0))
    twice = np.frombuffer(b"x" + b"same bytes here" * 2 + b"yz", np.uint8)
    x, y = suffix_dedup.content_hashes(twice, np.array([1, 16]), np.array([16, 31]))
    assert x[0] == x[1] and y[0] == y[1]


def test_suffix_dedup_of_hot_passages_and_pieces(spark, monkeypatch):
    """A line in most documents with ever different surroundings, copies, and texts longer than a chunk: hot keys, chunk limits and pieces change no result."""
    rng = np.random.default_rng(8)
    noise = lambda k: "".join(rng.choice(list("abcdefghij "), k))
    line = "This very line of some fifty bytes stands everywhere."
    texts = [noise(int(rng.integers(30, 90))) + (line if i % 3 else "") + noise(int(rng.integers(0, 90))) for i in range(90)]
    texts += [texts[5]] * 6 + [line * 9, noise(2000) + line + noise(900) + line]
    rows = list(enumerate(texts))
    want = brute_dedup(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hot = set()
    found = suffix_dedup._hot_keys
    monkeypatch.setattr(suffix_dedup, "_hot_keys", lambda *a: (hot.update(found(*a).tolist()), found(*a))[1])
    for sizes in ({"chunk_bytes": 700, "in_chunk": 2}, {"hot_segments": 20, "hot_in_batch": 2}, {"chunk_bytes": 700, "in_chunk": 1, "hot_segments": 10, "hot_in_batch": 2}):
        assert sorted((tuple(r) for r in suffix_dedup.suffix_dedup(frame, **sizes).collect()), key=str) == want
    assert hot
