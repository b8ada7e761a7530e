"""Pages, token files, languages, tool calls, archives and the SQL of the operators."""

import json
import random
import re
import zlib
from html import unescape

import numpy as np
import oracle
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickloom.llm import catalog, langmix, sitestyle, tokenfile, toolcalls, warc
from clickloom.llm.dom import content_blocks, parse

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    columns, rows = oracle.actual(catalog.QUERIES[name](spark, SF))
    assert (columns, rows) == oracle.expected(oracle.connect(SF), catalog.ORACLE[name])


def article(html):
    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_page_texts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in sitestyle.main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def text_of(html):
    return [b.text for b, fine in content_blocks(html) if fine]


def test_page_structure():
    assert text_of("<p>a&nbsp;&amp;&eacute;<br>b <b>c</b>d<script>x<p>y</script><p> e\n\tf") == ["a &é b cd", "e f"]
    assert text_of('<div class="wrap has-sidebar"><div class=sidebar>s</div><main><h1>t</h1><p>u</p></main></div><footer>f') == ["t", "u"]
    assert text_of('<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>x</p><section id="comments"><p>c</p></section></article>') == ["T", "x"]
    assert text_of('<body><ul class="menu"><li>m</li></ul><p>one two three four</p><form><p>f</p></form><div hidden>h</div></body>') == ["one two three four"]
    assert text_of("<table><td>1<td>2</td><tr><td>3</table>< b & c") == ["1", "2", "3", "< b & c"]
    assert text_of("") == [] and text_of("plain <") == ["plain <"] and text_of('<p title="a>b" x=\'">z') != []
    assert text_of("<!-- <p>no</p> --><![CDATA[yes]]>") == ["yes"]
    deep = "<div>" * 3000 + "end" + "</div>" * 3000
    assert text_of(deep) == ["end"] and parse(deep)[1][-1].depth > 2000


def test_site_template_goes_and_copies_stay(spark):
    draw = random.Random(3)
    own = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    bodies = [[own(20), own(15)] for _ in range(30)]
    html = lambda b: f"<body><div class=top><p>Welcome to our site</p></div><div><p>{b[0]}</p><p>{b[1]}</p><p>Sign in to read more</p></div>"
    rows = [(k, f"http://One.example/{k}", html(b), 1) for k, b in enumerate(bodies)]
    rows += [(100 + k, f"http://two.example/{k}", html(bodies[0]), 1) for k in range(20)]  # one page, many copies
    rows += [(200, None, None, 1), (201, "x", "", 1), (None, "http://one.example/", html(bodies[1]), 1)] + [(202, "u", "<p>z", 1)] * 2
    got = {}
    found = sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    for r in found:
        got.setdefault(r.page_id, []).append(r.text)
    assert len(found) == len(rows)
    assert all(got[k] == ["\n\n".join(b)] for k, b in enumerate(bodies))
    assert all(bodies[0][0] in got[100 + k][0] for k in range(20))
    assert got[200] == [""] and got[201] == [""] and got[202] == ["z", "z"]
    assert sitestyle.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("shared", [1, 10, 20])
def test_template_of_many_blocks_goes(spark, shared):
    draw = random.Random(shared)
    own = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for host in "abc":
        template = "".join(f"<p>{own(4)}</p>" for _ in range(shared))
        page = lambda b: f"<body><div>{template}</div><div>{''.join(f'<p>{x}</p>' for x in b)}</div>"  # noqa: B023, E731
        bodies = [[own(20) for _ in range(3)] for _ in range(200)]
        for k, body in enumerate([*bodies, *[bodies[0]] * 2000]):  # many copies of one page
            rows.append((len(rows), f"http://{host}.example/{k}", page(body)))
            want[rows[-1][0]] = "\n\n".join(body)
    found = sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == want


def test_heading_equal_to_a_menu_entry_stays(spark):
    menu = "<nav><ul><li>Home</li><li>Prices</li><li>Contact</li></ul></nav>"
    heads = {3: "Prices", 7: "Contact"}
    html = lambda k: f"<body>{menu}<article><h1>{heads.get(k, f'Title {k}')}</h1><p>Text of page {k} only</p></article>"
    rows = [(k, f"http://a.example/{k}", html(k)) for k in range(40)]
    found = sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"{heads.get(k, f'Title {k}')}\n\nText of page {k} only" for k in range(40)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.sampled_from([1, 8]), st.integers(1, 70))
def test_planes_round_trip(ids, unit, block):
    import io

    out = io.BytesIO()
    writer = tokenfile.Writer(out, unit, 2**17, block)
    docs = [np.array(ids[k : k + 17], "<u4") for k in range(0, len(ids), 17)] + [np.zeros(0, "<u4")]
    for k, d in enumerate(docs):
        writer.add(k if k else None, d)
    writer.close()
    reader = tokenfile.Reader(out)
    assert reader.docs == [None, *range(1, len(docs))]
    for k in reversed(range(len(docs))):
        assert reader.document(k).tolist() == docs[k].tolist()


PLAIN_TEXT = st.text(alphabet=st.sampled_from("abZ019'stredvmlÀéŸßÿŽ -_#<|>.\n\t\r"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), PLAIN_TEXT))
def test_pieces_encode_as_whole_texts(text):
    whole, by_piece = WHOLE, ENCODER
    text = text.encode("utf-8", "ignore").decode()
    for t in (text, f"AΣ {text}\u0301 <|endoftext|>x's  {text[::-1]}", text.replace("a", " \u0301")):
        assert next(by_piece([t])).tolist() == next(whole([t])).tolist()


ENCODER, WHOLE = tokenfile.Encoder(VOCABULARY), tokenfile.Encoder(VOCABULARY, whole=True)


def test_token_files(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(-5, None), (10**12, ""), (None, "null id"), (7777, "long word " * 30_000), (8888, "twice"), (8888, "twice")]
    found = tokenfile.token_table(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, file int"), VOCABULARY)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found.collect()))
    tokenizer, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((start, doc, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    empty = tokenfile.token_table(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY)
    assert empty.collect() == []


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, len(r.text)) for r in docs.collect()}
    found = langmix.predict_languages(docs).collect()
    assert {r.doc_id for r in found if r.held_out} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    held = [r for r in found if r.held_out and truth[r.doc_id][1] >= 20]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_mixtures_and_odd_rows(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    en, de = (max((t for _, t, x in docs if x == lang), key=len) for lang in ("en", "de"))
    extra = [(5000, en[:3000] + " " + de[:1500], None), (5001, None, "en"), (5002, "123 !? \n", "en"), (5003, "", None), (None, "x", "en"), (5004, "§ 5", None)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langmix.predict_languages(frame).collect()}
    both = got[5000].proportions
    assert set(both) == {"en", "de"} and abs(both["en"] - 2 / 3) < 0.1 and got[5000].lang_pred == "en"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (5001, 5002, 5003, 5004))
    alone = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langmix.predict_languages(alone).first().lang_pred == "und"
    assert langmix.predict_languages(frame.limit(0)).collect() == []


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"content": "", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    result = lambda i, c="r": json.dumps({"tool_call_id": i, "content": c})
    schema = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}}
    tools = json.dumps({"tools": [{"name": "find", "parameters": schema}]})
    rows = [
        (1, 0, "system", tools), (1, 1, "user", "hé \"x\""), (1, 2, "tool", result("a")),
        (1, 3, "assistant", call(("a", "find", {"q": "x", "n": 2}), ("b", "find", {"n": 0}))),
        (1, 4, "assistant", call(("c", "find", {"q": "$b"}))), (1, 5, "tool", result("c")), (1, 6, "tool", result("b")),
        (1, 7, "tool", result("zz")), (2, 0, "assistant", call(("a", "other", {}))), (3, 0, "assistant", call(("p", "f", {"x": "$p"}))),
        (3, 1, "tool", result("p")), (4, 0, "user", None), (4, 0, "user", None), (None, 1, "user", "{bad"), (5, None, "user", '{"tools": 1'),
    ]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, place string")
    found = toolcalls.link_tool_calls(frame).collect()
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): r for r in found}
    one = sorted((r for r in found if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_depth, r.turn))
    assert [r.turn for r in one] == [0, 1, 3, 2, 6, 4, 5, 7]
    assert (by[1, 3].n_calls, by[1, 3].n_answered, by[1, 3].n_invalid) == (2, 2, 1)
    assert by[1, 4].n_invalid == 0 and by[2, 0].n_invalid == 1 and by[1, 2].linked and not by[1, 7].linked and by[1, 7].is_result
    assert by[3, 0].n_forward == 1 and by[1, 4].n_forward == 0
    assert by[1, 1].message == '{"content":"hé \\"x\\"","role":"user"}'
    assert by[1, 5].message == '{"content":"r","role":"tool","tool_call_id":"c"}'
    assert by[None, 1].message == '{"content":"{bad","role":"user"}'
    assert toolcalls.link_tool_calls(frame.limit(0)).collect() == []


def test_schema_rules():
    check = toolcalls.violation
    assert check({"a": [1, 2]}, {"properties": {"a": {"type": "array", "items": {"type": "integer"}}}}) is None
    assert check({"a": [1, "x"]}, {"properties": {"a": {"items": {"type": "integer"}}}}) == "$.a[1]: not of type integer"
    assert check(True, {"type": "integer"}) and check(3.0, {"type": "integer"}) is None and check("z", {"enum": ["a"]})


@pytest.mark.parametrize("value, schema", [
    ("$5.00", {"type": "integer"}), (1, {"anyOf": [{"type": "string"}]}), (1, {"oneOf": [{}, {"type": "integer"}]}),
    (1, {"allOf": [{"minimum": 2}]}), (1, {"not": {"const": 1}}), ({"a": 1}, {"properties": {"a": False}}),
    ({"a": 1}, {"properties": {"a": {"$ref": "#/$defs/t"}}, "$defs": {"t": {"type": "string"}}}), ("b", {"pattern": "^a"}),
    (1, {"exclusiveMinimum": 1}), (1, {"exclusiveMaximum": 1}), (0.25, {"multipleOf": 0.1}), ([], {"minItems": 1}),
    ([1], {"maxItems": 0}), ([1, 1.0], {"uniqueItems": True}), ({"b": 1}, {"additionalProperties": {"type": "string"}}),
])
def test_schema_keywords(value, schema):
    assert toolcalls.violation(value, schema)
    assert toolcalls.violation("$a", schema, refs={"a"}) is None


def test_references_and_unknown_keywords(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    whole = {"properties": {"n": {"type": "integer"}}}
    tools = json.dumps({"tools": [{"name": "f", "parameters": whole}, {"name": "g", "parameters": {"dependentRequired": {}}}]})
    rows = [(1, 0, "system", tools), (1, 1, "assistant", call(("a", "f", {"n": 1}), ("b", "f", {"n": "$a"}), ("c", "f", {"n": "$d"}))),
            (1, 2, "assistant", call(("d", "f", {"n": "$zz"}), ("e", "g", {}), ("h", "f", {"n": "$b"})))]
    found = toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.turn, r.n_calls, r.n_invalid, r.n_unchecked) for r in found.collect()) == [(0, 0, 0, 0), (1, 3, 1, 0), (2, 3, 1, 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
def test_loser_tree_merges(runs):
    runs = [[(str(k), n, 0, "u", str(v).zfill(3), v) for n, v in enumerate(sorted(r))] for k, r in enumerate(runs)]
    got = list(warc.merge(runs))
    assert [r[5] for r in got] == sorted(v[5] for r in runs for v in r) and len(set(got)) == sum(map(len, runs))


def test_archives(spark):
    big, small = "é<p>" * 60, "tiny"
    rows = [(k, f"http://www.B{k % 3}.example:80/x?q={k}", big if k % 4 else small, 0) for k in range(60)]
    rows += [(100, None, None, 0), (101, "http://[bad", "z" * 100, 0), (102, "u\r\nX: y", "z" * 100, 0), (None, "v", "z" * 100, 0)] + [(103, "w", "q" * 200, 0)] * 2
    found = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string, run int")).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    assert by[1].record_type == "response" and by[2].refers_to == 1 and by[0].record_type == by[4].record_type == "response"
    assert by[2].payload_bytes == len(big.encode()) and by[102].refers_to == 101 and by[None].refers_to == 101
    assert [r.record_type for r in found if r.page_id == 103] == ["response"] * 2
    ordered = sorted(found, key=lambda r: r.order_no)
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)
    assert warc.url_key("HTTP://www.A.Example:8080/P?q=R#f") == "example,a:8080)/p?q=R"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(empty).collect() == []


def test_hostile_json_stays_plain_or_escaped(spark):
    """Lone surrogates, endless nesting, values that are no JSON, and repeated keys: a row each, valid JSON."""
    deep = "[" * 200_000
    tools = json.dumps({"tools": [{"name": "f", "parameters": {"type": "object", "additionalProperties": False}}]})
    texts = [
        tools,
        '{"content": "\\ud800 x", "tool_calls": []}',
        '{"content": ' + deep,
        '{"content": ' + "[" * 5000 + "]" * 5000 + "}",
        '{"content": NaN}', '{"content": 1e400}', '{"content": 1, "content": 2}',
        '{"tool_calls": [{"id": "a", "name": "f", "arguments": "{\\"\\\\ud800\\": 1}"}]}',
        json.dumps({"tool_calls": [{"id": "b", "name": "f", "arguments": '{"k": ' + deep}]}),
        '{"tool_calls": [{"id": "c", "name": "f", "arguments": "{\\"k\\": Infinity}"}]}',
    ]
    rows = [(1, k, "assistant", text) for k, text in enumerate(texts)]
    found = toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.turn: r for r in found.collect()}
    assert len(got) == len(texts)
    for k, row in got.items():
        value = toolcalls.parsed(row.message)
        assert value["role"] == "assistant"
        if k in (2, 4, 5, 6):
            assert value == {"content": texts[k], "role": "assistant"}
    assert json.loads(got[1].message)["content"] == "\ud800 x"
    assert [got[k].n_invalid for k in (7, 8, 9)] == [1, 1, 1]


def test_token_digest_needs_no_join(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    plan = tokenfile.token_table(docs, VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
