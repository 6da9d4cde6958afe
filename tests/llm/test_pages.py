import random
import time
import tracemalloc

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import decontaminate, page_text

PAGES = "page_id bigint, url string, html string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    found = sorted(page_text.shared_lines(a, b))
    assert len(found) == size[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in found)


def test_structure():
    page = """<html><head><title>t</title></head><body><header><p>Site</p></header><nav><a>Home</a></nav><div class="ad">Buy</div><div id='cookie-notice'>We use</div>
    <article><h1>Title &amp; more</h1><p>One <b>bold</b>
    text<p>Two&nbsp;words<br>here<ul><li>x<li>y</ul><script>var a = "<p>no</p>";</script><form><input>Name</form><div class="comments" data-id=article><p>First!</p></div></article>
    <aside>Other</aside><footer>&copy; us</footer>"""
    lines = page_text.page_lines(page)
    assert page_text.main_text(lines, []) == "Title & more\nOne bold text\nTwo words here\nx\ny"
    assert page_text.page_lines("") == [] and page_text.main_text([], []) == ""
    assert [x.text for x in page_text.page_lines("<p>a < b</p><p title='x>y'>c</i></p></div>d &lt;")] == ["a < b", "c", "d <"]
    assert [x.text for x in page_text.page_lines("<p>&<b>amp;</b></p><p>x<!-- <p> -->y<![CDATA[z]]></p><script>never closed")] == ["&amp;", "xy"]
    assert [x.chrome for x in page_text.page_lines("<div data-id='ad'>a</div><div data-role=navigation>b</div><div role=navigation>c</div>")] == [False, False, True]


@pytest.mark.parametrize("page", ['<a ""' * 250_000, "<a ''" * 99_999 + ">x", "<a " * 300_000, "<p title='>" * 90_000, "<!--" * 200_000, "<div>" * 150_000 + "x" + "</div>" * 150_000, "<" * 500_000, "<script>" * 90_000])
def test_parsing_takes_linear_time(page):
    began = time.time()
    page_text.page_lines(page)
    assert time.time() - began < 5


def test_long_pages_align_in_little_memory():
    rng = random.Random(3)
    a = [str(rng.randrange(4000)) for _ in range(20_000)]
    b = [x for x in a if rng.random() < 0.9]
    for k in range(0, len(b), 9):
        b.insert(k, f"only {k % 7}")
    tracemalloc.start()
    found = page_text.shared_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    rest = iter(b)
    assert all(a[i] in rest for i in sorted(found)) and len(found) >= sum(not x.startswith("only") for x in b)


@pytest.mark.parametrize("bits", [8, 64, 1 << 20])
@settings(max_examples=100, deadline=None)
@given(a=st.lists(st.sampled_from("abc"), max_size=12), b=st.lists(st.sampled_from("abc"), max_size=12))
def test_halving_keeps_the_length(bits, a, b):
    held, page_text.TRACE_BITS = page_text.TRACE_BITS, bits
    try:
        i, j = page_text.aligned(a, b)
    finally:
        page_text.TRACE_BITS = held
    assert [a[x] for x in i] == [b[x] for x in j] and i == sorted(set(i)) and j == sorted(set(j)) and len(i) == len(page_text.shared_lines(a, b))


def site_page(rng, body, shell="shell", tail="Subscribe to our letter"):
    """A page without any element or name that tells what it is."""
    menu = "".join(f"<div><p>{shell} {k}</p></div>" for k in range(3))
    return f"<body><div class='x'>{menu}</div><div class='y'>{rng.random()} offer</div><div class='z'>{''.join(f'<p>{x}</p>' for x in body)}<p>{tail}</p></div><div class='w'>{shell} end</div></body>"


def test_differencing_alone_finds_the_article():
    rng = random.Random(1)
    lines = [page_text.page_lines(site_page(rng, [f"word {k} of page" * 4, "a passage that all but one have"][: 1 + (k != 2)])) for k in range(5)]
    assert page_text.main_text(lines[0], lines[1:]) == "word 0 of page" * 4 + "\na passage that all but one have"
    assert page_text.main_text(lines[0], [lines[1]]).startswith("word 0")
    # Without pairs the page's own words vote, and no line is known to be template.
    assert page_text.main_text(lines[0], []).endswith("Subscribe to our letter")


def test_copies_of_an_article_keep_it():
    page = lambda shell: f"<body><nav><p>{shell}</p></nav><article><h1>Same</h1><p>one text in all</p></article><footer>{shell} and more {shell}</footer></body>"
    lines = [page_text.page_lines(page(w * 9)) for w in ("a ", "b ", "c ", "d ")]
    assert page_text.main_text(lines[0], lines[1:]) == "Same\none text in all"


def brute_force_texts(rows):
    """Pairs, alignments by the full table, on one sorted list of all pages."""

    def key(r):
        host, _, path = (r[1] or "").split("://")[-1].partition("/")
        return host.lower(), "/" + path if path else "", r[0] is not None, r[0] or 0, r[1] or ""

    runs = []
    for r in sorted(rows, key=key):
        lines = page_text.page_lines(r[2] or "")
        if runs and runs[-1][:2] == [key(r)[0], lines]:
            runs[-1][2].append(r)
        else:
            runs.append([key(r)[0], lines, [r]])

    def side(i, step):
        out = []
        for j in range(i + step, i + 3 * step, step):
            if not 0 <= j < len(runs) or runs[j][0] != runs[i][0]:
                break
            if runs[j][1] != runs[i][1]:
                out.append(runs[j][1])
        return out

    def table_pair(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                size[i][j] = size[i + 1][j + 1] + 1 if a[i][:2] == b[j][:2] else max(size[i + 1][j], size[i][j + 1])
        i = j = 0
        sa, sb = set(), set()
        while i < len(a) and j < len(b):
            if a[i][:2] == b[j][:2]:
                sa.add(i), sb.add(j)
                i, j = i + 1, j + 1
            elif size[i + 1][j] >= size[i][j + 1]:
                i += 1
            else:
                j += 1
        words = {}
        for lines, shared in ((a, sa), (b, sb)):
            for k, x in enumerate(lines):
                if k not in shared:
                    words[x.path] = words.get(x.path, 0) + len(x.text.split(" "))
        return page_text.Pair(sa, words)

    out = []
    for i, (_, lines, own) in enumerate(runs):
        kept = page_text.kept_lines(lines, [table_pair(lines, x) for x in side(i, -1) + side(i, 1)])
        text = "\n".join(lines[k].text for k in kept)
        out += [(r[0], r[1], text, len(text)) for r in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 7, 41])
def test_the_query_equals_brute_force_at_any_partitioning(spark, monkeypatch, n):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        host = rng.choice(["hot.example", "hot.example", "HOT.example", "b.example", "c.example"])
        body = [f"{rng.choice(['alpha', 'beta', 'gamma'])} {rng.random()} text of page {k}" for _ in range(rng.randint(1, 4))]
        rows.append((k, f"https://{host}/{rng.choice('xyz')}/{rng.randint(1, 60)}", site_page(rng, body, shell=f"shell{rng.randint(0, 1)}")))
    rows += [(1000 + k, "http://hot.example/y/5", rows[3][2]) for k in range(60)] + [rows[3]] * 40  # copies, and one row again and again
    rows += [(None, None, None), (7, None, "<p>x</p>"), (8, "http://alone.example", "<p>alone</p>"), (9, "http://hot.example/x", ""), (None, "http://b.example/x/3", rows[5][2])]
    rng.shuffle(rows)
    monkeypatch.setattr(page_text, "PART_BYTES", 1 << 30)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        frame = spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", text string").repartition(3)
        got = sorted((tuple(r) for r in page_text.extract_text(frame).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == brute_force_texts(rows)


def test_no_pages_and_odd_pages(spark):
    assert page_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0
    plain = lambda body: f"<body><p>Welcome to the site</p><p>{body}</p><p>All rights reserved</p></body>"
    rows = [(k, f"http://a.example/x/{k}", plain(f"page number {k} says something")) for k in range(4)]
    texts = {r.page_id: r.text for r in page_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts == {k: f"page number {k} says something" for k in range(4)}


def edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_is_complete():
    rng = random.Random(7)
    letter = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    items = [(i, decontaminate.normal(letter(rng.randint(60, 160)))) for i in range(12)] + [(90, "short"), (91, "")]
    p = decontaminate.index_passages(items)
    texts = []
    for _ in range(40):
        chars = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, len(chars) // 9)):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(k, rng.choice("abcdef")), lambda: chars.insert(k, rng.choice("abcdef")), lambda: chars.pop(k)])()
        texts.append(decontaminate.normal(letter(50) + "".join(chars) + letter(50)))
    texts += ["", "a short one", items[0][1]]
    got = {(t, i): e for t, i, e, _ in decontaminate.find(texts, p)}
    want = {}
    for t, text in enumerate(texts):
        for i, item in items[:12]:
            if (e := edits(item, text)) <= decontaminate.edits_allowed(len(item), decontaminate.Q, decontaminate.EDIT_RATE):
                want[t, i] = e
        if "short" in text:
            want[t, 90] = 0
    assert got == want and len(want) > 10


@pytest.mark.parametrize("pairs, window, cells", [(50, 1 << 21, 1 << 18), (50, 300, 200), (1 << 20, 250, 50)])
def test_small_steps_give_the_same(monkeypatch, pairs, window, cells):
    rng = random.Random(11)
    letter = lambda n: "".join(rng.choice("ab") for _ in range(n))
    items = [(rng.choice([None, 1, 2, 3, 4]), t) for t in [letter(rng.randint(12, 80)) for _ in range(9)] + ["a" * 60, "a" * 40, "ab" * 30, "b" * 7, "b" * 7]]
    texts = ["a" * 700, "", "ba" * 200, *(letter(rng.randint(0, 400)) + rng.choice(items)[1] + letter(50) for _ in range(12))]
    p = decontaminate.index_passages(items)
    want = decontaminate.find(texts, p)
    for name, value in (("PAIRS", pairs), ("WINDOW", window), ("CELLS", cells)):
        monkeypatch.setattr(decontaminate, name, value)
    assert decontaminate.find(texts, p) == want
    exact = {}
    for t, text in enumerate(texts):
        for i, item in items:
            budget = decontaminate.edits_allowed(len(item), decontaminate.Q, decontaminate.EDIT_RATE)
            e = edits(item, text) if len(item) >= decontaminate.Q else int(item not in text)
            if e <= budget:
                exact[t, i] = min(e, exact.get((t, i), e))
    assert {(t, i): e for t, i, e, _ in want} == exact


def peak_of(items, texts):
    tracemalloc.start()
    p = decontaminate.index_passages(items)
    found = decontaminate.find(texts, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30, peak
    return found


def test_memory_is_bounded():
    rng = random.Random(2)
    assert peak_of([(1, "x" * 400)], ["x" * 10_000_000]) == [(0, 1, 0, 400)]
    assert peak_of([(1, "x" * 400), (2, "x" * 390 + "y" * 200)], ["x" * 100_000]) == [(0, 1, 0, 400)]
    short = [(k, f"passage {k} of many that are short and differ {rng.random()}") for k in range(1000)]
    assert peak_of([*short, (-1, "".join(rng.choice("abcdefgh ") for _ in range(2_000_000)))], ["before " + short[7][1] + " after"]) == [(0, 7, 0, 7 + len(short[7][1]))]
    many = [(k, f"passage {k} {rng.random()} and a common end of all") for k in range(100_000)]
    assert peak_of(many, [many[4][1] + " z", "and a common end of all " * 2])[0][:3] == (0, 4, 0)


def test_passage_never_spans_two_texts():
    item = "abcdefghij klmnopqrst uvwxyz abcdefghij klmnop"
    p = decontaminate.index_passages([(1, item)])
    assert decontaminate.find([item[:23], item[23:]], p) == []


def test_contaminations_and_drop(spark):
    fox = "The quick brown fox jumps over the lazy dog and runs away"
    bench = spark.createDataFrame([(1, fox), (1, fox + " again"), (2, None), (3, "")], "item_id bigint, text string")
    leak = "before it. the QUICK brown  fox jumps over\nthe lazy dog and runs away, after"
    rows = [(1, leak, "k"), (2, "clean text about foxes", "k"), (3, None, None), (4, "", "k"), (None, leak, "k"), (6, "z " * 60_000 + leak, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    assert sorted(str(r.doc_id) for r in decontaminate.contaminations(docs, bench).collect()) == ["1", "6", "None"]
    nameless = spark.createDataFrame([(None, fox)], bench.schema)
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminations(docs, nameless).collect()) == [("1", None), ("6", None), ("None", None)]
    assert decontaminate.drop_contaminated(docs, nameless).count() == 3
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("limit", [100, 1 << 20])
def test_passages_come_in_blocks(spark, limit):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    blocks = list(decontaminate.passage_blocks(bench.unionAll(bench), limit))
    assert sum(map(len, blocks)) == 2 * bench.count() and (len(blocks) > 1) == (limit == 100)
    ids = [{i for i, _ in b} for b in blocks]
    assert sum(map(len, ids)) == bench.select("item_id").distinct().count()
    docs = spark.createDataFrame([(1, f"see {bench.first().text} here")], "doc_id bigint, text string")
    held, decontaminate.passage_blocks.__defaults__ = decontaminate.passage_blocks.__defaults__, (limit,)
    try:
        assert [r.item_id for r in decontaminate.contaminations(docs, bench).collect()] == [bench.first().item_id]
        assert decontaminate.drop_contaminated(docs, bench).count() == 0
    finally:
        decontaminate.passage_blocks.__defaults__ = held
