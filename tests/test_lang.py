import pytest

from blockflow.functions.dialect import rewrite, statements
from blockflow.lang import assertions, options, template
from blockflow.lang.parser import ScriptError, parse
from blockflow.sources import excel, http_json, outputs


def test_blocks_and_clauses():
    s = parse("""
        DESCRIPTION 'a job'
        -- a comment
        INCLUDE 'x.txt'
        DECLARE @Id; SET MODE = 'Prod';
        CONNECTION 'Db' ( Driver = 'sqlite3', ConnectionString = 'x.db' )
        QUERY 'q1' FROM CONNECTION Db AS 'd' ( SELECT ')' AS "a" -- not a ) here
        ) USING PARAMETER @Id INTO CONSOLE, GLOBAL WITH (TABLE = 't', N = 2.5) AFTER q0
        TRANSFORM PLUGIN 'p' FROM BLOCK q1, BLOCK q2 () INTO PARAMETER (@Id)
        TEST q1 WITH ASSERTIONS ( IT OUTPUTS AT LEAST 1 ROWS; )
    """)
    assert s.description == "a job" and s.includes == ["x.txt"] and s.declared == ["@id"] and s.settings == {"MODE": "Prod"}
    q, p = s.of("query")[0], s.of("transform")[0]
    assert "')'" in q.body and q.parameters == ["@id"] and [e.kind for e in q.sinks] == ["console", "global"]
    assert q.options == {"TABLE": "t", "N": 2.5} and q.after == ["q0"] and q.sources[0].alias == "d"
    assert p.plugin and [e.name for e in p.sources] == ["q1", "q2"] and p.sinks[0].variables == ["@id"]


@pytest.mark.parametrize("text", ["QUERY 'a' (x)", "QUERY 'a' FROM GLOBAL (x", "FOO", "SET X 1", "DECLARE @a DECLARE @A"])
def test_bad_scripts(text):
    with pytest.raises(ScriptError):
        parse(text)


def test_option_precedence_and_truth():
    assert options.find("o1", {"ASDF_O1": 1.0, "O2": 2.0}, {"O1": 3.0}, namespace="asdf") == 1.0
    assert options.find("O3", {"O1": 1.0}, {"O3": 4.0}) == 4.0 and options.find("x", {}) is None
    assert options.truth("TRUE") and options.truth(1.0) and not options.truth("no") and not options.truth(0.0)


def test_templates():
    v = {"Key": "x", "N": 2.0, "MODE": "Prod"}
    assert template.render("a {{ .Key }} {{.N}} {{ .Nope }}", v) == "a x 2 <no value>"
    assert template.render('{{ if eq .MODE "Prod" }}p{{ else }}q{{ end }}{{ if .Nope }}z{{ end }}!', v) == "p!"
    with pytest.raises(ValueError):
        template.render("{{ if .Key }}", v)


def test_template_actions():
    v = {"Names": ["a", "b"], "MODE": "Test", "n": 3.0, "Empty": [], "Place": {"City": "X"}}
    for text, want in (
        ('{{ if eq .MODE "Prod" }}p{{ else if eq .MODE "Test" }}t{{ else }}q{{ end }}', "t"),
        ("{{ if .Nope }}1{{ else if .Empty }}2{{ else if .n }}3{{ else }}4{{ end }}5", "35"),
        ("{{ range .Names }}<{{ . }}>{{ end }}", "<a><b>"),
        ("{{ range $i, $x := .Names }}{{ if $i }}, {{ end }}{{ $x }}{{ $.MODE }}{{ end }}", "aTest, bTest"),
        ("{{ range .Empty }}x{{ else }}none{{ end }}", "none"),
        ("{{ with .Place }}{{ .City }}{{ else }}?{{ end }}{{ with .Nope }}y{{ end }}", "X"),
        ('{{ $q := printf "%03d-%s" .n .MODE }}{{ $q }}{{ $q | len }}', "003-Test8"),
        ('{{ index .Names 1 }} {{ .Names | len }} {{ and .n .MODE }} {{ or .Nope "d" }} {{ not .n }}', "b 2 Test d false"),
        ("a  {{- .n -}}  b{{/* nothing */}}", "a3b"),
        ('{{ if and (gt .n 2) (lt .n 10.5) }}in{{ end }}{{ "x y" | urlquery }}{{ html "<" }}', "inx+y&lt;"),
        ("{{ $x := 1 }}{{ if .n }}{{ $x := 2 }}{{ $x }}{{ end }}{{ $x }}", "21"),
    ):
        assert template.render(text, v) == want, text
    for bad in ("{{ end }}", "{{ else }}", "{{ if .n }}", "{{ nope .n }}", "{{ }}", "{{ .n 1 }}", "{{ $y }}", "{{ len (1 }}"):
        with pytest.raises(ValueError):
            template.render(bad, v)


def test_chat_handler():
    import json
    import logging

    from blockflow.runtime.forward import ChatHandler

    sent = []
    h = ChatHandler("http://hook", channel="#x", lines=2, send=lambda url, body: sent.append(json.loads(body)))
    log = logging.Logger("job")
    log.addHandler(h)
    log.debug("below the level")
    log.info("one")
    assert not sent
    log.info("two %d", 2)
    log.error("bad")
    log.info("last")
    h.close()
    assert [[a["text"] for a in m["attachments"]] for m in sent] == [["one", "two 2"], ["bad"], ["last"]]
    assert sent[1]["attachments"][0]["color"] == "danger" and sent[0]["channel"] == "#x"


def test_excel_templates_keep_the_book(tmp_path):
    import zipfile

    base, out = str(tmp_path / "base.xlsx"), str(tmp_path / "out.xlsx")
    excel.write_excel([["h", "i"], [1, 2], [3, 4]], base, "S", "A1:B*")
    with zipfile.ZipFile(base) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b'<c r="B2">', b'<c r="B2" s="7">')
    parts["xl/other.xml"] = b"<kept/>"
    with zipfile.ZipFile(base, "w") as z:
        for n, content in parts.items():
            z.writestr(n, content)
    excel.write_excel([[9, "x"]], out, "S", "B2:*2", template=base)
    assert excel.read_cells(out, "S") == {(1, 1): "h", (1, 2): "i", (2, 1): 1.0, (2, 2): 9.0, (2, 3): "x", (3, 1): 3.0, (3, 2): 4.0}
    with zipfile.ZipFile(out) as z:
        assert z.read("xl/other.xml") == b"<kept/>" and b's="7"' in z.read("xl/worksheets/sheet1.xml")
    with pytest.raises(ValueError):
        excel.write_excel([[1]], str(tmp_path / "no.xlsx"), "T", "A1:*1", template=base)


def test_dialect():
    assert rewrite("SELECT TOP 3 a AS 'B c' FROM t WHERE x LIKE '%as ''q''%'") == "SELECT a AS `B c` FROM t WHERE x ILIKE '%as ''q''%' LIMIT 3"
    assert statements("a; b ';' c -- d;\n; ") == ["a", "b ';' c"]


def test_ranges_recipients_and_pages():
    assert excel.parse_range("A2:*1") == (1, 2, None, 1) and excel.parse_range("A2:A*") == (1, 2, 1, None)
    for bad in ("A*:B]", "A1:**", "A1"):
        with pytest.raises(ValueError):
            excel.parse_range(bad)
    assert outputs.recipients("Adam <  adam@adam.com>, James Jameson <jj@jj.co.uk>") == [("Adam", "adam@adam.com"), ("James Jameson", "jj@jj.co.uk")]
    for bad in ("a@b.com; c@d.com", "a:b@c.com"):
        with pytest.raises(ValueError):
            outputs.recipients(bad)
    assert http_json.page_url("http://h/x", "limit", "offset", 25, 0) == "http://h/x?limit=25&offset=0"
    assert http_json.rows_of('{"items":[{"a":1,"b":2,"c":"d"}]}', ["c", "b"], "items") == [["d", 2]]
    assert http_json.rows_of('[[1,"d",2]]', ["a", "c", "b"], None) == [[1, "d", 2]]


def test_assertion_texts():
    kinds = [a.kind for a in assertions.parse("IT OUTPUTS AT LEAST 2 ROWS; COLUMN a HAS UNIQUE VALUES;\n COLUMN b HAS AT MOST 3 DISTINCT VALUES; COLUMN c HAS NO NULL VALUES; IT SATISFIES x == 1;")]
    assert kinds == ["rows", "unique", "distinct", "no null", "satisfies"]
    with pytest.raises(SyntaxError):
        assertions.parse("IT OUTPUTS SOME ROWS")
