"""Emphasis, nested payloads, pages and identity: published examples and brute force."""

import json
import random
import re
from html.parser import HTMLParser

import pytest

from opinara.operators import collect as C
from opinara.operators import nested as N
from opinara.operators import pages as H
from opinara.operators import valence as V

VALENCES = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "great": 3.1, "sux": -1.5, "bad": -2.5, "kind": 2.4, "no": -1.2, "uncompelling": -0.9}
# sentences with the scores (compound, positive, negative, neutral) that the rules' authors give for them
SAID = [
    ("VADER is smart, handsome, and funny.", 0.8316, 0.746, 0.0, 0.254),
    ("VADER is smart, handsome, and funny!", 0.8439, 0.752, 0.0, 0.248),
    ("VADER is very smart, handsome, and funny.", 0.8545, 0.701, 0.0, 0.299),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227, 0.754, 0.0, 0.246),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342, 0.767, 0.0, 0.233),
    ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469, 0.706, 0.0, 0.294),
    ("VADER is not smart, handsome, nor funny.", -0.7424, 0.0, 0.646, 0.354),
    ("The book was good.", 0.4404, 0.492, 0.0, 0.508),
    ("At least it isn't a horrible book.", 0.431, 0.322, 0.0, 0.678),
    ("The book was only kind of good.", 0.3832, 0.303, 0.0, 0.697),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042, 0.094, 0.327, 0.579),
    ("Today SUX!", -0.5461, 0.0, 0.779, 0.221),
    ("Not bad at all", 0.431, 0.487, 0.0, 0.513),
    ("", 0.0, 0.0, 0.0, 0.0),
    (None, 0.0, 0.0, 0.0, 0.0),
    ("   ", 0.0, 0.0, 0.0, 0.0),
]


@pytest.mark.parametrize("literal_rows", [10_000, 0])
def test_emphasis_gives_the_published_scores(spark, literal_rows):
    """Also where the lexicon is joined with the tokens instead of standing in the expressions."""
    rows = spark.createDataFrame([(k, s[0]) for k, s in enumerate(SAID)], "review_id int, text string")
    lexicon = spark.createDataFrame([*VALENCES.items(), ("GOOD", 5.0), (None, 1.0)], "term string, valence double")
    got = {r.review_id: r for r in V.scored(rows, lexicon, literal_rows=literal_rows).collect()}
    for k, (_, *want) in enumerate(SAID):
        r = got[k]
        assert [r.compound, r.positive_score, r.negative_score, r.neutral_score] == want
        assert r.label == ("positive" if r.compound >= 0.05 else "negative" if r.compound <= -0.05 else "neutral") and r.confidence == getattr(r, f"{r.label}_score")
    none = V.scored(rows, lexicon.where("false"), literal_rows=literal_rows).collect()
    assert {r.compound for r in none} == {0.0} and V.scored(rows.where("false"), lexicon).collect() == []


def candidates(value, title=None):
    """The records of a payload by recursion."""
    text_of = lambda x, keys: next((x[k] for k in keys if isinstance(x.get(k), str) and x[k].strip()), None)
    if isinstance(value, list):
        for x in value:
            yield from candidates(x, title)
    elif isinstance(value, dict):
        title = text_of(value, N.INHERITED_KEYS) or title
        if text := text_of(value, N.TEXT_KEYS):
            yield (title or text_of(value, N.TITLE_KEYS), " ".join(text.split()))
            return
        for x in value.values():
            yield from candidates(x, title)


def random_json(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 5 else 3)
    if kind == 0:
        return rng.choice([None, True, 3, 2.5, -1])
    if kind < 4:
        return rng.choice(["", " ", "some text", "x", "y\n z", "12345678-1234-5678-1234-567812345678", "{ABCDEF78123456781234567812345678}"])
    if kind == 4:
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    keys = ["review_text", "body", "comment", "id", "name", "product_title", "title", "items", "data", "evidenceId", "reviewId", "evidenceIds", "Url", "text"]
    return {k: random_json(rng, depth + 1) for k in rng.sample(keys, rng.randint(0, 6))}


def ids_of(value):
    from uuid import UUID

    found, valid = set(), lambda x: re.fullmatch("[0-9a-f]{32}", str(x).lower().replace("urn:", "").replace("uuid:", "").strip("{}").replace("-", ""))
    if isinstance(value, dict):
        own = value.get("evidenceId") or value.get("reviewId")
        if isinstance(own, str) and valid(own):
            found.add(str(UUID(own)))
        for k, x in value.items():
            if k in N.EVIDENCE_LISTS and isinstance(x, list):
                found |= {str(UUID(y)) for y in x if isinstance(y, str) and valid(y)}
            else:
                found |= ids_of(x)
    elif isinstance(value, list):
        found = set().union(*map(ids_of, value)) if value else set()
    return found


def compact(value, key=None, lists=2, entries=3, chars=4):
    if key and key.lower() in N.LEFT_OUT_KEYS:
        return N.SPOKEN if key.lower() in N.SPOKEN_KEYS else N.LEFT_OUT
    if isinstance(value, dict):
        return {k: compact(value[k], k) for k in sorted(value)[:entries]}
    if isinstance(value, list):
        return [compact(x) for x in value[:lists]]
    return value[:chars] if isinstance(value, str) else value


def test_nested_walks_equal_recursion(spark):
    rng = random.Random(11)
    values = [random_json(rng) for _ in range(150)] + [[], {}, "text", None]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(900, "no json"), (901, None), (902, '{"body": "one", "body": "two"}')]
    df = spark.createDataFrame(rows, "k int, payload string")
    got = sorted(((r.k, r.title, r.text) for r in N.records(df, keep=["k"], requested_url="https://e.x").collect()), key=str)
    want = sorted(((k, *c) for k, v in enumerate(values) for c in candidates(v) if len(c[1]) >= 3), key=str)
    assert got == want and len(want) > 20
    ids = {(r.k, r.evidence_id) for r in N.evidence_ids(df, keep=["k"]).collect()}
    assert ids == {(k, x) for k, v in enumerate(values) for x in ids_of(v)} and ids
    small = {r.k: r.compact for r in N.compacted(df, "k", list_limit=2, dict_limit=3, text_limit=4).collect()}
    assert len(small) == len(rows) and small[900] is None and small[901] is None
    assert all(json.loads(small[k]) == compact(v) for k, v in enumerate(values))
    with pytest.raises(ValueError, match="levels"):
        N.records(spark.createDataFrame([(0, "[" * 9 + "]" * 9)], "k int, payload string"), max_depth=3)
    assert N.records(df.where("false"), keep=["k"]).collect() == []


def test_records_agree_by_id_or_url_and_text(spark):
    long = "word " * 60
    items = [{"id": 1, "text": "same text"}, {"id": 2, "text": "same text"}, {"id": 1, "text": "Same  TEXT"}, {"url": "https://a/1", "text": long + "a"}, {"url": "https://a/1", "text": long + "b", "stars": 5}, {"text": "no id"}, {"id": 3, "text": "ab"}]
    got = C.normalize(N.records(spark.createDataFrame([(json.dumps(items),)], "payload string"))).collect()
    assert sorted((r.record_id or "", r.text[:9]) for r in got) == [("", "word word"), ("1", "same text"), ("2", "same text")]


def test_identity_by_the_rules(spark):
    entity = C.Entity(name="Acme  One", brand="Acme", model="X2", sku="S-1", url="https://www.a.b/p/", identifiers=("id9",), aliases=("Oney",))
    rows = [
        ("Acme One", None, None, None), ("Acme One max", None, None, None), ("the Acme-One max Oney", None, None, None), ("the good old Acme-One max", None, None, None), ("Acmes One", None, None, None), ("new acme x2", None, None, None),
        ("Oney!", None, None, None), ("Oneys", None, None, None), ("other", None, "s-1", None), ("other", None, None, "http://A.b/p?q=1"), ("other", None, None, "https://a.b/p2"), ("?", "my acme one", None, None), ("other", None, "ID9", None), (None, None, None, None),
    ]
    got = C.identified(spark.createDataFrame(rows, "title string, text string, sku string, url string"), entity).collect()
    assert [(r.title, r.method, r.confidence) for r in got] == [("Acme One", "name", 0.95), ("the good old Acme-One max", "name", 0.95), ("new acme x2", "brand_model", 0.92), ("Oney!", "alias", 0.9), ("other", "sku", 0.99), ("other", "url", 0.98), ("?", "name", 0.95), ("other", "identifier", 0.99)]
    # a variant among the first two words that stay rejected "Acme One max" and "the Acme-One max", though the alias Oney stands there
    bare = C.identified(spark.createDataFrame([("x",)], "title string"), C.Entity(name="")).collect()
    assert bare == []


class Tree(HTMLParser):
    """A page as nested lists [tag, attributes, children]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in H.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in H.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        self.stack[-1][2].append(("break",))  # any end tag ends a piece of text
        if tag in [n[0] for n in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)

    def handle_comment(self, data):
        self.stack[-1][2].append(("comment",))


def below(node):
    for x in node[2]:
        if isinstance(x, list):
            yield x
            yield from below(x)


def text_of(node):
    out, held = [], []

    def walk(x, silent):
        if isinstance(x, str):
            held.append((x, silent))
            return
        flush()
        if isinstance(x, list):
            for y in x[2]:
                walk(y, silent or x[0] in H.SILENT)
            flush()

    def flush():
        if held and not held[0][1] and (s := "".join(x for x, _ in held).strip()):
            out.append(s)
        held.clear()

    for x in node[2]:
        walk(x, node[0] in H.SILENT)
    flush()
    return "".join(out) or None


def slow_records(html, sets=H.SELECTOR_SETS):
    root = Tree(html).root
    for s, one in enumerate(sets):
        found = [n for n in below(root) if H.compiled(one["container"])(n[0], n[1])]
        if found:
            rows = []
            for n in found:
                field = {f: next((text_of(x) for x in below(n) if H.compiled(one.get(f))(x[0], x[1])), None) for f in H.FIELDS}
                rows.append((field["text"] or text_of(n), field["reviewer"], H._rating(field["rating"]), field["date"]))
            return s, rows
    return None, []


def test_pages_equal_a_tree_walk():
    rng = random.Random(5)
    sets = [{k: H.compiled(one.get(k)) for k in ("container", *H.FIELDS)} for one in H.SELECTOR_SETS]
    opens = ['<div class="review">', '<div itemprop="review">', '<div itemtype="https://schema.org/Review">', "<p>", '<span class="author x">', '<b class="rating">', '<i data-rating="3">', "<time>", '<em itemprop="reviewBody">', '<u itemprop="ratingValue">', "<li>", "<script>", '<p class="comment">', "<br>", "<img/>", "<b/>"]
    others = ["</div>", "</p>", "</span>", "</b>", "</li>", "</script>", "</i>", " 4.5 ", "5 of 5", "7", "a&amp;b", " text ", "<!-- no -->", "1.2.3"]
    seen = 0
    for _ in range(1500):
        html = "".join(rng.choice(opens if rng.random() < 0.5 else others) for _ in range(rng.randint(0, 25)))
        got = H.read(html, sets)
        assert got == slow_records(html), html
        seen += len(got[1])
    assert seen > 500 and H.read(None, sets) == (None, [])


def test_pages_give_every_record_and_take_selectors(spark):
    many = "".join(f"<li class='review'><span class='author'>u{k}</span><p>text {k}</p></li>" for k in range(300))
    pages = spark.createDataFrame([(1, many), (2, None), (3, "<q id='z'><s x='1'>own</s></q>"), (4, "<div class='review'></div>")], "page_id int, html string")
    got = H.records(pages).collect()
    assert [(r.k, r.text, r.reviewer) for r in got if r.page_id == 1] == [(k, f"text {k}", f"u{k}") for k in range(300)]
    assert [(r.page_id, r.text) for r in got if r.page_id != 1] == [(4, None)]
    own = H.records(pages, selectors={"container": "q#z, nope", "text": "s[x='1']"}).collect()
    assert [(r.page_id, r.text) for r in own] == [(3, "own")]
    for bad in ("div > p", "p:first-child", "a b"):
        with pytest.raises(ValueError, match="selector"):
            H.records(pages, selectors={"container": bad})
    assert H.records(pages.where("false")).collect() == []
