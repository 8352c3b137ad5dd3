"""Pieces of the text operators against plain versions."""

import html
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from signaldeck.llm import html_extraction, jaccard_join, substring_dedup
from signaldeck.llm.components import components
from signaldeck.llm.decontamination import ItemAutomaton, cut_spans
from signaldeck.llm.line_dedup import LineRuns
from signaldeck.llm.packing import SumOfSquares
from signaldeck.llm.quality_classifier import Network
from signaldeck.llm.token_files import CanonicalCode, _arrays, code_lengths


def test_sum_of_squares_takes_the_best_level():
    rng = np.random.default_rng(0)
    packer = SumOfSquares(32)
    for k in range(400):
        size = int(rng.integers(1, 32))
        counts = packer._count.copy()

        def total(level, size=size, counts=counts):
            new = counts.copy()
            if level:
                new[level] -= 1
            if level + size < 32:
                new[level + size] += 1
            return int((new * new).sum())

        options = [0] + [h for h in range(1, 33 - size) if counts[h]]
        assert total(packer.level_for(size)) == min(map(total, options))
        packer.place((k, 0, np.zeros(size)), size)
    sizes = [sum(len(p[2]) for p in s) for s in packer.close()]
    assert all(x & (x - 1) == 0 for x in sizes)


def test_code_lengths_are_optimal_and_limited():
    counts = {i: 1 << i for i in range(12)}
    free = code_lengths(counts, 20)
    assert sorted(free.values()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    for longest in (4, 5, 7):
        tight = code_lengths(counts, longest)
        assert max(tight.values()) <= longest and sum(2.0 ** -x for x in tight.values()) <= 1
    assert code_lengths({5: 3}) == {5: 1}
    with pytest.raises(ValueError):
        code_lengths(counts, 3)


@pytest.mark.parametrize("stride", [1, 7, 64])
def test_code_round_trip(stride):
    from signaldeck.llm.token_files import decode_block

    rng = np.random.default_rng(stride)
    ids = (rng.zipf(1.3, 5000) % 3000).astype(np.uint32)
    counts = np.array([1, 64, 65, 0, 870, 4000])
    code = CanonicalCode(*_arrays(code_lengths(dict(zip(*np.unique(ids, return_counts=True), strict=True)), 13)))
    keep = counts[counts > 0]
    stream, sizes, steps, _ = code.encode(ids, keep, stride)
    assert (decode_block(code, keep.tolist(), sizes.tolist(), stream, steps.astype("<u2").tobytes(), stride) == ids).all()


def test_automaton_shards_and_cutting():
    found = ItemAutomaton([("a", [b"%d" % i for i in range(12)]), ("b", [b"x", b"y"])], 10)
    words = [b"0", *[b"%d" % i for i in range(12)], b"x", b"y", b"x"]
    assert found.match(words) == ([(1, 15)], {"a", "b"})
    assert cut_spans("Ab, (cd) éf; gh!".encode(), [{"begin": 1, "end": 3}]) == "Ab, (; gh!"


def test_line_runs_are_compacted(spark):
    runs = LineRuns(spark, fanout=2)
    for batch in range(5):
        rows = [(b"a", batch), (b"%d" % batch, batch), (b"b" if batch > 2 else b"c", batch)]
        runs.add(spark.createDataFrame(rows, "line binary, doc bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(bytes(r.line), r.top) for r in runs.repeated(3).collect()} == {(b"a", 4), (b"c", 2)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(50, 70)] + [(3, 3), (66, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in [7, 200, *range(50, 70)]} == {7} and got[3] == 3


def sets(texts):
    return jaccard_join.shingle_sets([t.encode() for t in texts], 3)


def test_pairs_of_blocks_find_all_links():
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join(base[:k] + ["e"] + base[k + 1 :]) for k in (0, 1, 2, 40, 98, 99)]
    whole = jaccard_join.verified(sets(texts), 90)
    parent = list(range(len(texts)))
    for block in (None, [0, 1, 0, 1, 0, 1]):
        for a, b in whole if block is None else jaccard_join.verified(sets(texts), 90, block):
            assert block is None or block[a] != block[b]
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert len(whole) == 5


def test_large_units_are_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "UNIT_DOCS", 3)
    base = [f"t{i}" for i in range(100)]
    rows = [(k, " ".join([*base[:k], "e", *base[k + 1 :]])) for k in range(12)] + [(50, "other text here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: r.component for r in jaccard_join.similar_classes(docs).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 50: 50}


def test_token_runs_over_batches():
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 40, 600))
    n, g = rng.integers(100, 200, 600), rng.permutation(600)
    order = np.lexsort((g, n, t))
    t, n, g = t[order], n[order], g[order]

    def pairs(cuts):
        runs, out = jaccard_join.TokenRuns(90), set()
        for a, b in zip([0, *cuts], [*cuts, 600], strict=True):
            out |= set(zip(*(x.tolist() for x in runs.add(t[a:b], n[a:b], g[a:b])), strict=True))
        none = np.zeros(0, np.int64)
        return out | set(zip(*(x.tolist() for x in runs.add(none, none, none, last=True)), strict=True))

    assert pairs([]) == pairs([5, 6, 100, 333]) and pairs([])


def test_shard_in_generations():
    words = [f"{i % 37}-{i // 90}".encode() for i in range(600)]
    texts = [words[k * 20 : k * 20 + 120] for k in (0, 3, 1, 3, 9, 2)]

    def spans(held):
        shard, out = substring_dedup.Shard(20, held), []
        for doc, text in enumerate(texts):
            out += shard.add(doc, 0, text)
        covered = {}
        for doc, a, b in out + shard.settle():
            covered.setdefault(doc, set()).update(range(a, b))
        return covered

    assert spans(1) == spans(150) == spans(10**6) and spans(1)


def test_automata_give_the_occurrences(monkeypatch):
    rng = np.random.default_rng(4)
    common = [f"c{i}".encode() for i in range(9)]
    texts = []
    for k in range(40):  # passages share phrases: the same nine words lie between different ones
        own = [f"w{rng.integers(40)}".encode() for _ in range(30)]
        texts.append(own[:10] + common + own[10:] + (texts[int(rng.integers(k))][3:36] if k % 3 == 2 else []))
    docs = {k: b" ".join(t).decode() for k, t in enumerate(texts)}

    def removed():
        shard, out = substring_dedup.Shard(20), {}
        for doc, text in enumerate(texts):
            shard.add(doc, 0, text)
        for doc, a, b in shard.settle():
            out.setdefault(doc, set()).update(range(a, b))
        return {doc: len(words) for doc, words in out.items()}

    want = {doc: n for doc, (_, n, _) in brute.repeated_words(docs).items() if n}
    assert removed() == want and len(want) > 5

    class Blind:
        add_word = make_automaton = lambda self, *_: None
        iter = lambda self, *_: iter(())

    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Blind)
    assert removed() == {}


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="home">
<div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="post post-%d"><h1>Title %d &amp; more</h1><p>First  paragraph with <b>bold</b>&nbsp;text<br>and a break.
<ul><li>item one<li>item <a href="x">two</a></ul><form><input value="q"><p>Sign up</p></form>
<p>Last one, with a < sign &lt;b&gt;.</div><div class="comments"><p>A reader says a lot of things here</p></div>
<aside>Related</aside><footer>&copy; me</footer></body></html>"""
TEXT = "Title %d & more\n\nFirst paragraph with bold text and a break.\n\nitem one\n\nitem two\n\nLast one, with a < sign <b>."


def test_extraction_by_host(spark):
    pages = [(i, "http://One.example/p", PAGE % (i, i)) for i in range(3)]
    pages += [(3, None, None), (4, "http://two.example", ""), (5, "x", "plain text only"), (6, "http://one.example:80/", "<p>short</p>")]
    pages += [(7, "http://one.example/", "<body><nav>only menus</nav></body>"), (8, None, "<article>" + "<p>long text &#233;</p>" * 9000 + "</article>")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extraction.extract(table).collect()}
    assert [got[i] for i in range(3)] == [TEXT % i for i in range(3)]
    assert [got[i] for i in (3, 4, 5, 6, 7)] == ["", "", "plain text only", "short", ""]
    assert got[8] == "\n\n".join([html.unescape("long text &#233;")] * 9000)


OPEN = "<p>An opening paragraph of the article.</p>"


@pytest.mark.parametrize("page, kept", [
    ('<body style="overflow-x:hidden" data-note=\'a hidden note\'><p>text</p></body>', ["text"]),
    ('<main data-hidden title="not hidden"><p>text</p></main>', ["text"]),
    ('<article class="a" data-class="ad" data-role="banner" data-id="search"><p>text</p></article>', ["text"]),
    ('<div data-role=navigation aria-label="role=banner"><p>text</p></div>', ["text"]),
    ('<div title="it is hidden><p>text</p></div>', ["text"]),
    ('<body style="display:none"><p>text</p></body>', ["text"]),
    ('<div style="display:none; display:block"><p>text</p></div>', ["text"]),
    ('<div style="background:url(display:none;display:none)"><p>text</p></div>', ["text"]),
    ("<div hidden><p>text</p></div><p>seen</p>", ["seen"]),
    ('<div class=a HIDDEN=""><p>text</p></div><p>seen</p>', ["seen"]),
    ('<div aria-hidden = true><p>text</p></div><p>seen</p>', ["seen"]),
    ('<div style="color:red; DISPLAY : none !important; display:block"><p>text</p></div><p>seen</p>', ["seen"]),
    (f'<article>{OPEN}<section id="discussion"><p>What it <a href="x">means</a>.</p></section></article>', ["An opening paragraph of the article.", "What it means."]),
    (f'<div class="post">{OPEN}<div class="level2" id="search"><h2>Search</h2><p>How to.</p></div></div>', ["An opening paragraph of the article.", "Search", "How to."]),
    (f'<article>{OPEN}<section id="related"><h2>More</h2><p><a href="x">One more story</a></section></article>', ["An opening paragraph of the article."]),
    (f'<article>{OPEN}<div class="related-work"><h2>Related work</h2><p>Others.</p></div></article>', ["An opening paragraph of the article.", "Related work", "Others."]),
    (f'<article>{OPEN}<section class="discussion"><h2>Discussion</h2><p>It holds.</p></section></article>', ["An opening paragraph of the article.", "Discussion", "It holds."]),
    (f'<article>{OPEN}<div class="alert"><p>Mind the gap.</p></div></article>', ["An opening paragraph of the article.", "Mind the gap."]),
    ('<article><div class="search"><h2>Search</h2><p>How search works.</p></div></article>', ["Search", "How search works."]),
    ('<article><div class="search"><p>Only this.</p></div></article>', ["Only this."]),
    (f'<article>{OPEN}<div class="related"><h2>More</h2><p><a href="x">One more story</a></p></div></article>', ["An opening paragraph of the article."]),
    (f'<article>{OPEN}<div class="ad"><h2>Buy</h2><p>Great things.</p></div><div class="newsletter"><h2>News</h2><p>Weekly.</p></div></article>', ["An opening paragraph of the article."]),
    (f'<div class="lead"><p>A lead with a third of it.</p></div><main>{OPEN}<p>And the rest.</p></main>', ["A lead with a third of it.", "An opening paragraph of the article.", "And the rest."]),
    (f'<article>{OPEN}<div id="ad-1">Buy this</div><div id="comments"><h2>Said</h2><p>I said so</div></article>', ["An opening paragraph of the article."]),
    (f'{OPEN}<div id="search"><h2>Search</h2><p>Type here</div>', ["An opening paragraph of the article."]),
])
def test_attributes_are_read_name_by_name(page, kept):
    blocks, holders = html_extraction.blocks_of(page)
    assert html_extraction.text_on(blocks, html_extraction.vote(blocks, holders)[0]) == kept


def test_host_without_article_elements_keeps_unequal_parts(spark):
    words = lambda n, k: " ".join(f"word{k}{i}" for i in range(n))
    page = '<body><nav>menu</nav><div class="post"><h1>T</h1>%s<div class="body"><p>%s</p></div></div> | <ul><li><a href="x">other</a></ul></body>'
    intro = '<div class="intro"><p>%s</p></div>'
    pages = [(k, "http://a.example/", page % (intro % words(n, "a"), words(100 - n, "b"))) for k, n in enumerate((30, 2, 49))]
    # Most pages of this host have one part, and a few have more around it.
    pages += [(k, "http://b.example/", page.replace("<h1>T</h1>", "") % ("", words(90, "b"))) for k in range(10, 15)]
    pages += [(15, "http://b.example/", page % (intro % words(40, "a"), words(60, "b")))]
    # An article element that holds little of the page does not stand for it, though it does elsewhere on the host.
    pages += [(k, "http://c.example/", f"<body><article><p>{words(50, 'b')}</p></article></body>") for k in range(20, 24)]
    pages += [(24, "http://c.example/", f"<body><div><p>{words(90, 'a')}</p></div><article><p>{words(10, 'b')}</p></article></body>")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_extraction.extract(table).collect()}
    assert [got[k] for k in range(3)] == [["T", words(n, "a"), words(100 - n, "b")] for n in (30, 2, 49)]
    assert all(got[k] == [words(90, "b")] for k in range(10, 15)) and got[15] == ["T", words(40, "a"), words(60, "b")]
    assert all(got[k] == [words(50, "b")] for k in range(20, 24)) and got[24] == [words(90, "a"), words(10, "b")]


def test_network_without_both_labels():
    network = Network(np.zeros((4, 3)), np.ones(4))
    assert np.allclose(network.score(np.zeros((2, 3))), 5 / 6)
    assert np.allclose(Network(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((1, 3))), 0.5)


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    from signaldeck.llm.quality_rules import quality_rules

    notice = "We value your privacy and so do our partners"
    rows = [(k, f"{notice}\nown words of text number {k} that nobody else has", "a") for k in range(6)]
    rows += [(10, f"  {notice.upper()} \n{notice}\nshort {notice[:5]}", "a"), (11, f"{notice}\nalone on its host with more words", "b")]
    rows += [(k, "an exact copy\nof the very same text that is no notice", None) for k in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc.doc_id: r for r in quality_rules(docs, max_share=0.3, min_docs=3, min_left=0.5, min_words=3).collect()}
    assert all(got[k].kept and got[k].kept_text == rows[k][1].split("\n")[1] and got[k].n_removed_lines == 1 for k in range(6))
    assert not got[10].kept and not got[10].base_failed and got[10].n_removed_lines == 2
    assert all(got[k].kept and got[k].n_removed_lines == 0 for k in [11, *range(20, 30)])


def test_extraction_of_odd_pages(spark):
    """Null and empty html, no url, repeated rows and ids, clashing columns and a very long page."""
    long = "<body><nav>menu</nav><article>" + "".join(f"<p>paragraph {i}</p>" for i in range(40_000)) + "</article></body>"
    pages = [(1, None, long), (1, None, long), (2, "http://a/", None), (None, "http://a/", "<p>no id</p>"), (3, "", ""), (3, None, "<p>no url</p>")]
    rows = [(*p, "x", 1) for p in pages]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, path int")).collect()
    want = "\n\n".join(f"paragraph {i}" for i in range(40_000))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=key) == sorted(
        [(1, None, want), (1, None, want), (2, "http://a/", ""), (None, "http://a/", "no id"), (3, "", ""), (3, None, "no url")], key=key)


def plain_article(page):
    """Text of generated pages, told by the furniture they were built with."""
    soup = re.sub(r"(?s)<(nav|footer|aside|script)>.*?</\1>", "", page)
    soup = re.sub(r'(?s)<div class="(?:ad|cookie-notice)">.*?</div>', "", soup)
    return [html.unescape(x.strip()) for x in re.split(r"<[^>]*>", soup) if x.strip()]


def test_generated_sites_against_a_plain_version(spark):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"w{rng.integers(999)}" for _ in range(n))
    pages, want = [], {}
    for k in range(60):
        site = k % 4
        parts = [f"<p>{words(rng.integers(3, 40))}</p>" for _ in range(rng.integers(1, 6))]
        junk = [f"<nav>{words(5)}</nav>", f'<div class="ad">{words(6)}</div>', f"<footer>{words(4)}</footer>", f'<div class="cookie-notice">{words(3)}</div>']
        lead = f'<div class="lead"><p>{words(12)}</p></div>' if site == 1 else ""
        inner = "".join(x for pair in zip(parts, [junk[1], "", "", "", ""]) for x in pair)
        wrap = ("<article>%s</article>", "<main>%s</main>", '<div class="content-7"><div>%s</div></div>', "<div><section>%s</section></div>")[site]
        page = f"<html><head><script>x</script></head><body>{junk[3]}{junk[0]}{lead}{wrap % inner}{junk[2]}</body></html>"
        pages.append((k, f"http://site{site}/{k}", page))
        want[k] = plain_article(page)
    got = html_extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text.split("\n\n") for r in got} == want
