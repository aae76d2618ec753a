from oosgauge.llm import html_extract as H


def kept_and_wanted(pages):
    for p in pages:
        tree, (_, _, y) = H.Tree(p), H.labelled_tree(p)
        yield H.trained().text(p).split("\n"), [t for t, v in zip(tree.text, y) if t and v]


def test_held_out_layouts():
    right = total = wrong = 0
    for got, want in kept_and_wanted(H.layouts(seed=99, n=80)):
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        total += len(set(want))
    assert right >= 0.97 * total
    assert wrong <= 0.03 * total


def test_marginals_are_exact():
    m = H.Model()
    m.edge = [[0.3, -0.2], [-0.9, 0.7]]
    parent, unary = [-1, 0, 0, 1, 1, 2], [0.2, -1.0, 0.5, 2.0, -0.3, 0.1]
    total, on = 0.0, [0.0] * 6
    import itertools
    import math

    for y in itertools.product((0, 1), repeat=6):
        w = math.exp(sum(u * v for u, v in zip(unary, y)) + sum(m.edge[y[parent[i]]][y[i]] for i in range(1, 6)))
        total += w
        on = [a + w * v for a, v in zip(on, y)]
    assert all(abs(a / total - b) < 1e-9 for a, b in zip(on, m.marginals(parent, unary)))


PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    "<!-- ad --><div class=ad>Buy this now.</div><article><h1>A headline &amp; more</h1><p><b>First  line\nof it.<br><p>Second &lt;b&gt; one with words, and more of them.</p></article>"
    "<div class=comments><p class=comment>I agree with all of this.</p></div><footer>&copy; us. All of it."
)


def test_a_page():
    assert H.trained().text(PAGE) == "A headline & more\nFirst line of it.\nSecond <b> one with words, and more of them."


def runs(body):
    return [t for t in H.Tree(body).text if t]


def test_silent_elements_end_where_they_should():
    assert runs("<p>a</p><script>for(i=0;i<n;i++){a[i]=0}</script><p>b</p>") == ["a", "b"]
    assert runs("<style>a<b{c:'</p>'}</STYLE ><p>b") == ["b"]
    assert runs("<p>a <textarea><p>no</textarea> b<script>never ended <p>c") == ["a b"]
    assert runs("<html><head><meta charset=utf-8><title>no <b</title><body><p>b") == ["b"]
    assert runs("<html><head><title>no</title><p>b</p>") == ["b"]
    assert runs("<head><noscript><style>p<q{}</style></head><p>b") == ["b"]
    assert runs("<p>a<svg width='1'/>b<svg><title>no</title><path/></svg>c") == ["a b c"]
    assert runs("<p>a<svg><path d=/><p>b") == ["a", "b"]
    assert runs("<div><button>no</div><p>b</p>") == ["b"]
    assert runs("<div><canvas><div>no</div>no</div><p>b</p>") == ["b"]
    assert runs("<ul><li>a<button>no<li>b</ul><p>c") == ["a", "b", "c"]
    assert runs("<p>a<button><div>no</div>no</button>b</p>") == ["a b"]
    assert runs("<p><b>a<video>no</b>b<object data=/x/>no</object>c") == ["a b c"]
    assert runs("<div><select><option>no<option>no</select>b<option>no</div>c") == ["b", "c"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p"), (4, "x", "<" * 50_000 + "&#x41;" + "<p>" * 3000)], "page_id long, url string, html string")
    got = {}
    for r in H.main_text(df).collect():
        got.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    want = H.trained().text(PAGE)
    assert got[1] == [("u", want, len(want))] * 2
    assert got[2] == [(None, "", 0)] and got[None] == [("v", "", 0)] and got[3] == [("w", "", 0)]
    assert H.main_text(df.limit(0)).count() == 0
