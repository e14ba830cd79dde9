import collections
import random
import time

from pyspark.sql import functions as F

from spindrift.llm.htmltext import ARTICLE, DOUBT, FURNISHED, MAIN, OTHER, REPEAT, covered_words, extract_text, page_blocks, page_name
from spindrift.llm.htmltext import main_texts as texts_of

NAV = '<nav><a href="/">Home</a> <a href="/x">All the many things that we have to offer</a></nav>'
FOOT = "<footer>&copy; 2024 &middot; all rights are reserved by the people who made this page</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}<!-- x <p>no</p> -->{body}{FOOT}</body></html>"


def main_texts(pages):
    blocks = [page_blocks(p) for p in pages]
    return texts_of(blocks, [page_name(b) for b in blocks])


def brute(pages):
    """pages: (name of the host, html). Texts by comparing all 8-word windows of all pages."""
    blocks = [page_blocks(h) for _, h in pages]
    whole = [tuple(w for t, _ in b for w in t.split()) for b in blocks]
    seen = collections.defaultdict(set)

    def stretches(page):
        """Runs of (block, word) outside articles."""
        run = []
        for k, (t, s) in enumerate(page):
            if s == ARTICLE:
                yield run
                run = []
            else:
                run += [(k, j, w) for j, w in enumerate(t.split())]
        yield run

    for (host, _), page, name in zip(pages, blocks, whole, strict=True):
        for run in stretches(page):
            for i in range(len(run) - REPEAT + 1):
                seen[host, tuple(w for _, _, w in run[i : i + REPEAT])].add(name)
    out = []
    for (host, _), page in zip(pages, blocks, strict=True):
        hit = {(k, j) for run in stretches(page) for i in range(len(run) - REPEAT + 1) for k, j, _ in run[i : i + REPEAT] if len(seen[host, tuple(w for _, _, w in run[i : i + REPEAT])]) > 1}
        states = {s for _, s in page}
        wanted = {ARTICLE, DOUBT} if states & {ARTICLE, DOUBT} else {MAIN} if MAIN in states else {OTHER}
        lines = []
        for k, (t, s) in enumerate(page):
            if s not in wanted:
                continue
            words = t.split()
            marks = [(k, j) in hit and s != ARTICLE for j in range(len(words))]
            if not all(marks):
                runs = "".join("x" if m else "." for m in marks).split(".")
                at, keep = 0, []
                for r in runs:  # a run of x, then one kept word
                    if len(r) < REPEAT:
                        keep += words[at : at + len(r)]
                    at += len(r)
                    keep += words[at : at + 1]
                    at += 1
                lines.append(" ".join(keep))
        out.append("\n".join(x for x in lines if x))
    return out


def test_article():
    body = '<div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>x &lt;y&gt; &#233;&nbsp;z</p><div id="comments"><p>nice</p></div><form>f<input></form><aside>s</aside>tail</article><div class="cookie-notice">ok</div>'
    assert main_texts([page(body)])[0][0] == "A & B\none two three\nx <y> é z\ntail"


def test_odd_markup():
    for h, want in [("", ""), ("plain & text", "plain & text"), ("<article><p>cut &am", "cut &am"), ("<article><p>a<b", "a"), ("a < b <3 c", "a < b <3 c"), ("<p>a</p></div></p>b", "a\nb"), ("<script>x", ""), ("<!-- open <p>x", ""), ('<p title="a>b">c</p>', "c"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<main>m<article>t</article></main>", "t"), ("<main>m</main><p>o", "m"), ("<p>\n \t</p>", "")]:
        assert main_texts([h])[0][0] == want, h


def test_repeats_equal_brute_force():
    pages = [[["a"] * 3 + list("bcdefghij")], [list("bcdefghij"), list("xyz")], [["q"]], [], [list("bcdefgh")], [list("abcdefghijklm") * 3]]
    covered = covered_words(pages, list(range(6)))
    flat = [[w for b in p for w in b] for p in pages]
    seen = collections.defaultdict(set)
    for k, words in enumerate(flat):
        for i in range(len(words) - REPEAT + 1):
            seen[tuple(words[i : i + REPEAT])].add(k)
    for k, words in enumerate(flat):
        hit = {i + j for i in range(len(words) - REPEAT + 1) for j in range(REPEAT) if len(seen[tuple(words[i : i + REPEAT])]) > 1}
        assert sum(int(c.sum()) for c in covered[k]) == len(hit)
    # no run crosses a gap
    assert not any(c.any() for p in covered_words([[list("abcd"), None, list("efgh")], [list("abcdefgh")]], [1, 2]) for c in p if c is not None)


def test_boilerplate_of_pages_without_article():
    shared = "<div>this long line of words stands on every single page of the host</div>"
    pages = [page(f"{shared}<div>only page {i} says {'abcdefghij'[i]} things like number {i}</div>") for i in range(4)]
    got = [t for t, _ in main_texts(pages)]
    assert got[2] == "only page 2 says c things like number 2"
    # copies of one page are one page
    assert "every single page" in main_texts([pages[0]] * 3)[0][0]


def test_operator(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", page(f"<article><p>text {i} &eacute;</p></article>")) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (3, rows[3][1], rows[3][2]), (102, "http://h0.org/big", page(f"<article>{'<p>word é</p>' * 20_000}</article>"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    for bucket in (2_000, 8 << 20):
        got = extract_text(df, bucket=bucket).collect()
        assert len(got) == len(rows)
        for r in got:
            want = "" if r["page_id"] in (100, 101) else "\n".join(["word é"] * 20_000) if r["page_id"] == 102 else f"text {r['page_id']} é"
            assert r["text"] == want and r["n_chars"] == len(want)
    assert extract_text(df.limit(0)).count() == 0


def test_test_tables(spark):
    got = extract_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert got.where(F.col("n_chars") == 0).count() == 0 and got.where(F.col("text").rlike("©|track\\(")).count() == 0


def test_blocks_keep_order():
    assert [t for t, _ in page_blocks("<p>1<p>2<div>3</div>4")] == ["1", "2", "3", "4"]


def test_runs_go_word_by_word():
    shared = "please read the terms of use of this site before you go on"
    for tag in ("div", "main"):
        few = [page(f"<{tag}><p>{shared} page {i} has {'abcd'[i]} few own words</p></{tag}>") for i in range(4)]
        assert [t for t, _ in main_texts(few)] == [f"{i} has {'abcd'[i]} few own words" for i in range(4)]
        many = [page(f"<{tag}><p>{' '.join(f'w{i}x{k}' for k in range(30))} {shared} {i}</p></{tag}>") for i in range(4)]
        assert [t for t, _ in main_texts(many)] == [" ".join(f"w{i}x{k}" for k in range(30)) + f" {i}" for i in range(4)]
    quoted = [page(f"<article><p>{shared} page {i}</p></article>") for i in range(4)]
    assert [t for t, _ in main_texts(quoted)] == [f"{shared} page {i}" for i in range(4)]


def test_names_inside_articles():
    for x, want in [('<div class="section banner-story"><p>Body</p></div>', "Body"), ('<table class="share-price"><tr><td>12</td></tr></table>', "12"), ('<p class="notice">prose</p>', "prose"), ('<ul class="menu-of-the-day"><li>soup</li></ul>', "soup"), ('<div class="ad">Buy</div>', ""), ('<nav>x</nav>', ""), ('<div id="comments"><p>nice</p></div>', "")]:
        assert main_texts([f"<article><p>t</p>{x}</article>"])[0][0] == f"t\n{want}".strip(), x
    # in doubt the index decides: what other pages hold too goes
    notice = '<p class="notice">this site will be closed for some hours on the coming sunday</p>'
    got = main_texts([page(f"<article><p>text {i}</p>{notice}<p class='notice'>but not {i}</p></article>") for i in range(3)])
    assert got[1] == ("text 1\nbut not 1", 12)


def test_linear_time():
    n = 60_000
    for h in ("<b>" * n + "</i>" * n, "<font>" * n + "<h1>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<p>x" * n, '<a "' * n, "<!--" * n, "<ul>" * n + "<li>x" * n):
        began = time.time()
        page_blocks(h)
        assert time.time() - began < 5, h[:40]


def site(rng, n):
    """Pages of three hosts with and without article, with shared lines, doubtful blocks and copies."""
    shared = [" ".join(f"s{k}x{i}" for i in range(7 + k)) for k in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for j in range(rng.randint(0, 5)):
            own = " ".join(f"p{i}x{j}x{k}" for k in range(rng.randint(0, 6)))
            tag = rng.choice(["div", 'div class="promo-box"', "p", "nav", "blockquote"])
            parts.append(f"<{tag}>{own} {rng.choice(shared)} {i}</{tag.split()[0]}>")
        body = "".join(parts)
        body = rng.choice([body, f"<main>{body}</main>", f"<article>{body}</article>{rng.choice(shared)}", f"{rng.choice(shared)}<article>{body}</article>"])
        rows.append((f"h{rng.randint(0, 2)}.org", page(body) if rng.random() < 0.8 else body))
    return rows + rows[:5]


def test_whole_texts_equal_brute_force(spark):
    rows = site(random.Random(11), 250)
    want = brute(rows)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)], "page_id long, url string, html string").repartition(6)
    for bucket in (8 << 20, 3_000):
        got = {r["page_id"]: r for r in extract_text(df, bucket=bucket).collect()}
        assert [got[i]["text"] for i in range(len(rows))] == want
        assert sum(r["n_removed"] > 0 for r in got.values()) > 30


def test_buckets_change_no_result(spark):
    rng = random.Random(5)
    shared = [" ".join(f"s{k}x{i}" for i in range(9 + k)) for k in range(12)]
    rows = []
    for i in range(60):
        parts = [f"<div>{' '.join(f'p{i}x{j}x{k}' for k in range(6))} {rng.choice(shared)} {i}</div>" for j in range(4)]
        rows.append((i, "http://one.org/", page("".join(parts)) if i % 3 else page(f"<article>{''.join(parts)}</article>")))
    rows += [(100 + i, "http://one.org/", rows[1][2].replace("<html>", f"<html><!-- {i} -->")) for i in range(5)]
    # copies of one page are one page, in whatever buckets they lie
    rows += [(200 + i, "http://two.org/", page(f"<p>{' '.join(f'c{k}' for k in range(300))}</p>")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole, dealt = ({r["page_id"]: (r["text"], r["n_removed"]) for r in extract_text(df, bucket=b).collect()} for b in (8 << 20, 2_000))
    assert len(whole) == len(rows) and dealt == whole
    assert whole[1][1] > 0 and whole[200][1] == 0


def test_formulas_stay_and_reader_comments_go(spark):
    inside = "<article><p>The area <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> here.</p>{}<p>End of it.</p></article>"
    parts = ["<div class='comment-thread'><p>I liked it</p></div>", "<div class='cookie-banner'>We use some</div>", "<section id='comments_list'><p>first!</p></section>", "<div class='big disqus-box'>talk</div>", "<p class='commentary'>A commentary.</p>"]
    rows = [(i, f"http://h{i}.org/", f"<html><body><div class='topbar'>Menu</div>{inside.format(p)}</body></html>") for i, p in enumerate(parts)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    plain = "The area x=2 here.\nEnd of it."
    assert got == {**dict.fromkeys(range(4), plain), 4: "The area x=2 here.\nA commentary.\nEnd of it."}


def test_every_page_goes_through_the_suffix_array(spark, monkeypatch):
    from spindrift.llm import htmltext

    html = ["<article><p>one whole article</p></article>", "<nav>menu</nav><article>two</article>", "<nav>only menu</nav>", None, "<p>plain text</p>"]
    pages = spark.createDataFrame([(i, f"http://{'ab'[i == 3]}.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    made, write = {}, htmltext.written
    monkeypatch.setattr(htmltext, "written", lambda df, tag: made.setdefault(tag, write(df, tag)))
    for bucket in (8 << 20, 4):
        made.clear()
        got = sorted(map(tuple, extract_text(pages, bucket=bucket).select("page_id", "text", "n_chars").collect()))
        assert got == [(0, "one whole article", 17), (1, "two", 3), (2, "", 0), (3, "", 0), (4, "plain text", 10)]
        assert made["parsed"].where("_blocks is not null").count() == 5 and made["hosts"].count() == 2
