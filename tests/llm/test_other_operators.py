import math
import random
import re

import numpy as np
import pytest

from jobweave.llm import embedding_links, html_text, url_filter

# --- vectors -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        base = rng.standard_normal(48)
        rows.append((k * 3, base, k % 4))
        if k % 5 == 0:
            rows.append((k * 3 + 1, base + 0.2 * rng.standard_normal(48), k % 4))
            rows.append((k * 3 + 2, base * 2.5, k % 4))
        if k % 50 == 0:
            rows += [(5000 + k, base, k % 4), (5001 + k, base, (k + 1) % 4), (5001 + k, base, (k + 1) % 4)]
    core = rng.standard_normal(48)
    rows += [(9000 + k, core + 0.15 * rng.standard_normal(48), 2) for k in range(700)]
    odd = [(1, None, 1), (2, [], 1), (4, [0.0] * 48, 1), (5, [float("nan")] * 48, 1), (7, [None] * 48, 1), (8, [1.0, 2.0], 1), (10, [1.0, 2.1], 1)]
    odd += [(None, [1.0, 2.2], 1), (20001, rows[0][1], None)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in [*rows, *odd]]


def test_links_equal_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").repartition(5)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_links.neighbours(df).collect()), key=repr)
    n = len(vectors)
    near = np.zeros((n, n), bool)
    usable = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in vectors]
    for lab in {r[2] for r in vectors if r[2] is not None}:
        for size in {len(r[1]) for r, u in zip(vectors, usable) if u}:
            own = [k for k in range(n) if usable[k] and vectors[k][2] == lab and len(vectors[k][1]) == size]
            if own:
                x = np.array([vectors[k][1] for k in own], float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near[np.ix_(own, own)] = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        new = np.array([min(label[k], label[near[k]].min(initial=n)) for k in range(n)])
        if (new == label).all():
            break
        label = new
    first = {c: min((vectors[k][0] for k in range(n) if label[k] == c and vectors[k][0] is not None), default=None) for c in set(label)}
    want = sorted(((vectors[k][0], int(near[k].sum()), first[label[k]]) for k in range(n)), key=repr)
    missed = sum(a != b for a, b in zip(got, want))
    links = sum(w[1] for w in want)
    assert len(got) == len(want) and sum(g[1] for g in got) >= 0.99 * links and missed <= 0.02 * n
    assert embedding_links.neighbours(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.4 * rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = embedding_links.codes_of(x)
    i, j = np.arange(200), np.arange(200, 400)
    value, width = embedding_links.estimates(x, codes, factors, i, j)
    true = (x[i] * x[j]).sum(1)
    assert abs((value - true).mean()) < 0.02 and (np.abs(value - true) <= width).all()


# --- pages -------------------------------------------------------------------------

SHELL = '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{}</body></html>'
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li>News</li></ul></nav><div class=\"ad\">Buy</div>"


def page(body):
    return SHELL.format(MENU + body + "<footer>&copy; us</footer>")


def test_main_text_of_odd_pages(spark):
    pages = [
        (1, "https://a.example/x/1", page("<article><h1>T &amp; t</h1><p><b>One\n two<br><p>Three &quot;x&quot;</p><aside>no</aside></article>"), "One two"),
        (2, "https://a.example/x/2", page("<article><h1>T &am</h1><p>a < b &amp</p><form>no</form><section class='comments'><p>no</p></section></article>"), None),
        (3, "https://a.example/y/1", SHELL.format("<div>Shared line</div><p>Own text one</p><div>Cookie line</div>"), None),
        (4, "https://a.example/y/2", SHELL.format("<div>Shared line</div><p>Own text two</p><div>Cookie line</div>"), None),
        (5, None, None, None),
        (6, "no url", "", None),
        (7, "https://a.example/x/1", "<article><p>cut &amp; <!-- open", None),
        (8, "https://b.example/", "plain text", None),
        (9, "https://b.example/long", page("<article>" + "<p>line</p>" * 20_000 + "</article>"), None),
    ]
    df = spark.createDataFrame([(*p[:3], "extra") for p in pages], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == 'T & t\nOne two\nThree "x"'
    assert got[2].text == "T &am\na < b &"
    assert got[3].text == "Own text one" and got[4].text == "Own text two"
    assert got[5].text == "" and got[6].text == "" and got[5].n_chars == 0
    assert got[7].text == "cut &" and got[8].text == "plain text"
    assert got[9].text == "\n".join(["line"] * 20_000)
    assert html_text.extract(df.limit(0)).count() == 0


def test_articles_keep_lines_that_pages_share(spark):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", page("<article><p>same</p></article>")) for k in range(5)], "page_id bigint, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {"same"}


def test_alignment_decides_free_lines_beside_an_article(spark):
    body = "<div>Shared line</div><p>Own lead {0}</p><article><p>Article {0}</p></article><p>Own end {0}</p><div>Cookie line</div>"
    df = spark.createDataFrame([(k, f"http://h.example/{k}", page(body.format(k))) for k in range(3)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {k: f"Own lead {k}\nArticle {k}\nOwn end {k}" for k in range(3)}


def test_texts_do_not_depend_on_the_number_of_ranges(spark):
    rng = random.Random(8)
    shared = [f"<div>Menu {rng.randint(0, 4)} of {s}</div>" for s in range(6)]
    rows = [(k, f"http://{rng.choice('ab')}.example/{rng.choice('xyz')}/{k % 70}", page("".join(rng.sample(shared, 4)) + f"<p>Own {k}</p>")) for k in range(150)]
    rows += [(None, "http://a.example/x/1", page("".join(shared) + "<p>Own null</p>")), (None, None, page(shared[0]))] + rows[:3] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    got = [sorted((str(r.page_id), str(r.url), r.text) for r in html_text.extract(df, ranges=n).collect()) for n in (1, 8, 200)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)

    def key(r):
        host, path = (r[1] or "://").split("://")[1].partition("/")[::2]
        return host, "/" + path if host else path, "" if r[0] is None else str(r[0])

    order = sorted({r[:3] for r in rows}, key=key)
    alone = {k: r for k, r in ((key(r), r) for r in order)}
    pages = [html_text.Page(r[:2], *key(r)[:2], *html_text.read_lines(r[2]), None, False) for r in order]
    for p in pages:
        p.names = html_text.line_names(p.lines, p.zones)
    assert len(alone) == len(order)
    once = {r[:3] for r in rows if rows.count(r) == 1}
    for k, p in enumerate(pages):
        if order[k] in once:
            want = html_text.main_text(p, pages[k - 1] if k else None, pages[k + 1] if k + 1 < len(pages) else None)
            near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            if all(n in once for n in near):
                assert (str(p.row[0]), str(p.row[1]), want) in got[0]


def test_common_lines_are_a_longest_run():
    mine, other = [(b"a", 1), (b"b", 1), (b"c", 1), (b"d", 1)], [(b"b", 1), (b"a", 1), (b"c", 1), (b"d", 1)]
    assert len(html_text.common_lines(mine, other)) == 3 and html_text.common_lines([], other) == set()


# --- urls --------------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    urls = [
        "http://X.Example.COM/en/1.html?q#f", "https://www.example.com/en/2", "http://a.net/es/1", "http://a.net/de/1", "http://a.org",
        None, "no scheme", "http://h?x/y", "ftp://example.com", "http://netto.org/es/", "x://net/fr/", "http://a.com#/en/",
    ]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[k].host for k in range(12)] == ["X.Example.COM".lower(), "www.example.com", "a.net", "a.net", "a.org", "", "", "h", "example.com", "netto.org", "net", "a.com"]
    assert [got[k].path for k in range(12)] == ["/en/1.html", "/en/2", "/es/1", "/de/1", "", "", "", "", "", "/es/", "/fr/", ""]
    assert [got[k].rule for k in range(12)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, None, None, "net/fr/", None]
    assert got[0].verdict == "block" and got[1].verdict == "allow" and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_templates_follow_labels(spark):
    rules = [("block", "bad.example/spam/"), ("allow", "bad.example/news/")]
    rows = [f"http://bad.example/spam/{k}/a" for k in range(80)] + [f"http://bad.example/news/{k}/a" for k in range(80)]
    rows += [f"http://x.bad.example/{w}/page" for w in ("one", "two")] * 3 + ["http://other.example/1"] * 2
    df = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert got[0].share > 0.9 and got[80].share < 0.1 and 0.4 < got[160].share < 0.6
    wide = spark.createDataFrame([(k, f"http://w.example/name{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}/x") for k in range(90)], "page_id bigint, url string")
    assert url_filter.judge(wide, []).select("share").distinct().count() == 1


def plain_verdicts(rows, rules):
    """Verdict by url of the rows without a rule, from a tree of dictionaries."""
    def rule_of(host, path):
        fit = [(len(r), v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fit)[1] if fit else None

    leaves = {}
    for host, path in rows:
        segments = tuple(re.sub("[0-9]+", "*", s) for s in path.split("/") if s)
        leaf = leaves.setdefault((host, segments), [0, 0])
        verdict = rule_of(host, path)
        leaf[0] += verdict is not None
        leaf[1] += verdict == "block"
    total = [sum(leaf[k] for leaf in leaves.values()) for k in (0, 1)]
    base, verdicts = (total[1] + 1) / (total[0] + 2), {}

    def smooth(n, b, over):
        share = (b + 5 * over) / (n + 5)
        return share, share - 1.645 * math.sqrt(share * (1 - share) / (n + 5))

    def apart(difference, share, weight):
        return abs(difference) > 2 * math.sqrt(max(share * (1 - share), 1e-4) * weight)

    def walk(host, members, level, over, floor):
        names = {m[level] if level < len(m) else "" for m in members}
        wide = len(names - {""}) > 50
        branches = {}
        for m in members:
            name = m[level] if level < len(m) else ""
            branches.setdefault("*" if wide and name else name, []).append(m)
        counts = {name: [sum(leaves[host, m][k] for m in ms) for k in (0, 1)] for name, ms in branches.items()}
        classes = []
        for name in sorted((x for x in counts if counts[x][0]), key=lambda x: (counts[x][1] / counts[x][0], x)):
            n, b = counts[name]
            if classes:
                m, c = counts[classes[-1][-1]]
                if not apart(b / n - c / m, (b + c) / (n + m), 1 / n + 1 / m):
                    classes[-1].append(name)
                    continue
            classes.append([name])
        for group in classes + [[x] for x in counts if not counts[x][0]]:
            n, b = (sum(counts[x][k] for x in group) for k in (0, 1))
            share, bound = smooth(n, b, over) if n and apart(b / n - over, over, 1 / n) else (over, floor)
            for x in group:
                if x == "" or len(branches[x]) == 1:
                    for m in branches[x]:
                        verdicts[host, m] = "block" if counts[x][0] and bound >= 0.5 else "allow"
                else:
                    below = level + 1
                    while len({m[below] if len(m) > below else None for m in branches[x]} | {None}) == 2 and all(len(m) > below for m in branches[x]):
                        below += 1
                    walk(host, branches[x], below, share, bound)

    for host in {h for h, _ in leaves}:
        members = [m for h, m in leaves if h == host]
        walk(host, members, 0, *smooth(*(sum(leaves[host, m][k] for m in members) for k in (0, 1)), base))
    return [rule_of(h, p) or verdicts[h, tuple(re.sub("[0-9]+", "*", s) for s in p.split("/") if s)] for h, p in rows]


def test_verdicts_equal_a_plain_tree(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    bad, good = ["u" + word(6) for _ in range(60)], ["v" + word(6) for _ in range(60)]
    rules = [("block", f"bad.example/{w}/") for w in bad[:50]] + [("allow", f"good.example/{w}/") for w in good[:50]]
    rules += [("block", "mix.example/deep/a/b/c/d/spam1"), ("allow", "mix.example/deep/a/b/c/d/news1"), ("block", "mix.example/p1/")]
    rows = [("bad.example", f"/{w}/x") for w in bad] + [("good.example", f"/{w}/x") for w in good] + [("un.example", "/en/1"), ("", "")]
    rows += [("mix.example", f"/deep/a/b/c/d/{w}{k}/z") for w in ("spam", "news", "none") for k in (1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 3)]
    rows += [("mix.example", f"/p{k}/{word(1)}") for k in (1, 1, 1, 2, 3, 4) * 5] + [("mix.example", "/" + "q/" * 60 + w) for w in "abc"]
    df = spark.createDataFrame([(k, f"http://{h}{p}" if h else None, "x", 1) for k, (h, p) in enumerate(rows)], "page_id bigint, url string, share string, branch int")
    got = {r.page_id: r.verdict for r in url_filter.judge(df.repartition(5), rules).collect()}
    assert [got[k] for k in range(len(rows))] == plain_verdicts(rows, rules)
    by_url = {row: got[k] for k, row in enumerate(rows)}
    assert {by_url["bad.example", f"/{w}/x"] for w in bad} == {"block"} and {by_url["good.example", f"/{w}/x"] for w in good} == {"allow"}
    assert by_url["mix.example", "/deep/a/b/c/d/spam2/z"] == "block" and by_url["mix.example", "/deep/a/b/c/d/news2/z"] == "allow"
    assert by_url["un.example", "/en/1"] == "allow"
