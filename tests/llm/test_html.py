import pytest

from auditlake.llm import html_text as ht

A = "Over the river the survey went on for days and the gauges were read."
B = "A second sentence stands for itself here, longer than most."


def page(content, before="", after=""):
    return (
        f"<!DOCTYPE html><html><head><title>{B}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></ul></nav>{before}{content}{after}"
        f"<footer>&copy; {A}</footer></body></html>"
    )


PAGES = [page(f"<article><h1>Title {n}</h1><p>{A}</p><p>{B}<br>end</p></article>", f"<div class=ad>{B}</div>") for n in range(60)]


@pytest.fixture(scope="module")
def model():
    return ht.fit([ht.leaf_blocks(p) for p in PAGES], layouts=1500)


def extracted(model, html):
    blocks = ht.leaf_blocks(html)
    keep = model.probabilities(ht.Pages([blocks])) >= ht.MAIN
    return [b[1] for b, kept in zip(blocks, keep, strict=True) if kept]


def test_blocks_of_malformed_pages():
    assert ht.leaf_blocks("") == [] and ht.leaf_blocks("<p> \n </p><!-- x") == []
    texts = [b[1] for b in ht.leaf_blocks("a &lt;b&gt;&nbsp; c<p>x<b>y</p> z</i></div><p>q<script>w")]
    assert texts == ["a <b> c", "xy", "z", "q"]
    (block,) = ht.leaf_blocks("<div class='side-bar Main' id=x1><a href=q>link</a> not</div>")
    assert block[0] == ("div", ".side", ".bar", ".main", ".x") and 0.4 < block[2] < 0.6


@pytest.mark.parametrize(
    "mark",
    ["<svg class='i'/>", "<svg />", "<svg>", "<SVG><path d=x /></SVG >", "<svg-icon name=a>", "<select-box>", "<title-bar/>", "<iframe src=x>", "<script-x>"],
)
def test_skipped_elements_take_no_more_than_themselves(mark):
    texts = [b[1] for b in ht.leaf_blocks(f"<p>{A}{mark}</p><p>{B}</p>" * 2)]
    assert texts == [A, B, A, B]


def test_unclosed_scripts_take_the_rest_and_many_unclosed_elements_stay_quick():
    for name in ("script", "style", "textarea", "title"):
        assert [b[1] for b in ht.leaf_blocks(f"<p>a<{name}>b<p>c</p>")] == ["a"]
    assert [b[1] for b in ht.leaf_blocks("<p>a<script src=x/>b</script>c<svg><p>d</p></svg>e")] == ["ace"]
    assert len(ht.leaf_blocks("<svg><p>a</p>" * 20_000)) == 20_000


def test_articles_of_layouts_like_the_sample(model):
    assert extracted(model, PAGES[0]) == ["Title 0", A, f"{B} end"]


def test_parts_around_are_left_out(model):
    noise = (
        f"<header class=site-header><h2>{B}</h2></header>",
        f"<aside><h3>Related</h3><p>{A}</p></aside>",
        f"<div class='cookie-notice'><p>{A}</p></div>",
        f"<form><label>Mail</label><p>{B}</p></form>",
        f"<div class=advert><p>{A}</p></div>",
        f"<section class=comments><h3>Comments</h3><div class=comment><p>{A}</p></div><div class=comment><p>{B}</p></div></section>",
    )
    for content in ("<article>{}</article>", "<div class=content>{}</div>", "<main>{}</main>"):
        body = content.format(f"<h1>Title</h1><p>{A}</p><p>{B}</p><p>{A}</p>")
        for part in noise:
            assert extracted(model, page(body, after=part)) == ["Title", A, B, A], part


def test_learning_lowers_the_loss_as_the_slopes_say():
    """The change of the loss along a step agrees with numeric slopes."""
    import numpy as np

    pages = ht.Pages([ht.leaf_blocks(p) for p in PAGES[:3]])
    labels = np.array([ht.teacher(b) for p in PAGES[:3] for b in ht.leaf_blocks(p)], dtype=np.float32)

    def loss(m):
        p = np.clip(m.probabilities(pages), 1e-7, 1 - 1e-7)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    model, memory = ht.Labeller(), {}
    model.learn(pages, labels, 0.0, memory)
    for name in ("f_in", "b_across", "path", "out"):
        slope = memory[name][0] / 0.1
        place = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        changed = []
        for step in (1e-2, -1e-2):
            model.weights[name][place] += step
            changed.append(loss(model))
            model.weights[name][place] -= step
        assert abs((changed[0] - changed[1]) / 2e-2 - slope[place]) < 0.05 * abs(slope[place]) + 1e-4, name


def div_page(n, content="post-text"):
    return (
        f"<html><body><div class=menu><a href=/>Home</a> <a href=/n>News</a></div><div class=page><div class='{content}'>"
        f"<h1>Title {n}</h1><p>{A}</p><p>{B} Gauge {n}.</p><p>{A} <a href=q>more</a></p></div><div class=sidebar><p>{B}</p></div></div>"
        f"<div class=footer>{A}</div></body></html>"
    )


def test_tables_without_article_or_main():
    """Articles in div containers only: they are kept, and parts around are not."""
    model = ht.fit([ht.leaf_blocks(div_page(k)) for k in range(60)], layouts=600)
    for k in range(60):
        assert extracted(model, div_page(k)) == [f"Title {k}", A, f"{B} Gauge {k}.", f"{A} more"]
    assert ht.fit([ht.leaf_blocks("<p>short</p>"), []]) is None


def test_pages_without_article_teach_by_density_and_others_by_their_elements():
    blocks = ht.leaf_blocks(div_page(1))
    assert ht.labels_of(blocks) == [0, 1, 1, 1, 1, 0, 0]
    assert ht.labels_of(ht.leaf_blocks(PAGES[0])) == [ht.teacher(b) for b in ht.leaf_blocks(PAGES[0])]
    assert ht.labels_of(ht.leaf_blocks("<article><nav>a</nav></article>")) is None and ht.labels_of([]) is None


def test_awkward_rows(spark):
    rows = [(k, f"http://h/{k}", p) for k, p in enumerate(PAGES)]
    rows += [(None, None, None), (100, "u", ""), (101, "u", "<p>"), (0, "http://h/0", PAGES[0])]
    rows += [(102, "u", page("<article>" + f"<p>{A}</p>" * 3000 + "</article>"))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS digest")
    found = {}
    for row in ht.main_text(frame, ht.train(frame)).collect():
        assert row.n_chars == len(row.text)
        found.setdefault(row.page_id, []).append(row.text)
    assert found[None] == found[100] == found[101] == [""]
    assert found[0] == [f"Title 0\n{A}\n{B} end"] * 2
    assert found[102] == ["\n".join([A] * 3000)]
    assert ht.main_text(frame.limit(0), ht.train(frame.limit(0))).count() == 0
