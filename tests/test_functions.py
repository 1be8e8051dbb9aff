import pytest
from pyspark.sql import functions as F

from timberline.functions import maps, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_kv(spark):
    kv = lambda s, *names: one(spark, maps.extract_kv(F.lit(s), *names))
    assert kv('status=200 method=GET path="/api/v1"') == {"status": "200", "method": "GET", "path": "/api/v1"}
    assert kv('msg="hello world" code=0') == {"msg": "hello world", "code": "0"}
    assert kv("a=1 a=2 =x y= z") == {"a": "2"} and kv("a=1 b=2", "b", "c") == {"b": "2"} and kv("") == {} and kv("a=b=c") == {"a": "b=c"}
    assert one(spark, maps.extract_kv(F.lit(None).cast("string"))) == {}


def test_normalize(spark):
    fields = F.create_map(F.lit("HOSTNAME"), F.lit("Server01"), F.lit("x"), F.lit("1"))
    assert one(spark, maps.normalize(fields, [maps.Rename("Hostname", "host")])) == {"host": "Server01", "x": "1"}
    assert one(spark, maps.normalize(fields, [maps.Rename("hostname", "a"), maps.Rename("hostname", "host", F.lower)])) == {"host": "server01", "x": "1"}
    assert one(spark, maps.normalize(F.lit(None).cast("map<string,string>"), [])) is None


def test_enrich(spark, monkeypatch):
    monkeypatch.setenv("TL_A", "1")
    given = {"k": "v"}
    p = maps.static(given)
    given["k"] = "changed"
    base = F.create_map(F.lit("k"), F.lit("old"), F.lit("z"), F.lit("0"))
    assert one(spark, maps.enrich(base, p)) == {"k": "v", "z": "0"}
    assert one(spark, maps.enrich(F.lit(None).cast("map<string,string>"), p, maps.static({"k": "w"}))) == {"k": "w"}
    assert one(spark, maps.enrich(base, maps.env(["TL_A", "TL_UNSET"], {"TL_A": "a"})))["a"] == "1"
    assert one(spark, maps.enrich(base, maps.host()))["host"]


def test_line_patterns(spark):
    p = maps.LinePattern("p", r"(?P<ts>\S+) (?P<level>\w+) (?P<msg>.+)")
    assert p.fields == ["ts", "level", "msg"]
    assert one(spark, p.match(F.lit("2024 ERROR disk full\n"))) == {"ts": "2024", "level": "ERROR", "msg": "disk full"}
    assert one(spark, p.match(F.lit("x"))) is None
    assert one(spark, maps.LinePattern("q", "(?P<a>x)|(?P<b>y)").match(F.lit("y"))) == {"a": "", "b": "y"}
    for bad in (("", "(?P<a>x)"), ("n", "x"), ("n", "(?P<a>x")):
        with pytest.raises(ValueError):
            maps.LinePattern(*bad)
    r = maps.PatternRegistry()
    r.register(maps.LinePattern("first", "(?P<a>x)"))
    r.register(maps.LinePattern("second", "(?P<a>[xy])"))
    with pytest.raises(ValueError):
        r.register(maps.LinePattern("first", "(?P<a>z)"))
    assert r.names() == ["first", "second"] and r.get("none") is None
    assert one(spark, r.match_first(F.lit("x")))["name"] == "first" and one(spark, r.match_first(F.lit("y")))["name"] == "second" and one(spark, r.match_first(F.lit("n"))) is None


def test_mask(spark):
    m = lambda s, *p: one(spark, text.mask(F.lit(s), p))
    assert m("user=alice password=hunter2 host=db", r"password=(\S+)") == "user=alice password=[REDACTED] host=db"
    assert m("a=1 a=2;", r"a=(\d);?", r"RED(AC)TED") == "a=[RED[REDACTED]TED] a=[RED[REDACTED]TED];"
    assert m("x1y x2y", "x(1)y|z") == "x[REDACTED]y x2y"
    with pytest.raises(ValueError):
        m("x", "no group")


def test_redact(spark):
    r = lambda s, p, *rest: one(spark, text.redact(F.lit(s), p, *rest))
    assert r("token=abc123 other=data", [r"token=\S+"], "***") == "*** other=data"
    assert r("a b", ["a", "b"]) == "[REDACTED] [REDACTED]" and r("key=v", [r"(key)=\S+"], "$1=?") == "key=?"


@pytest.mark.parametrize("s", ["short", "exactly 10", "a much longer ascii line", "日本語のログメッセージ", "éé" * 9, "😀😀😀😀", ""])
@pytest.mark.parametrize("most,suffix", [(10, "..."), (10, ""), (10, "→"), (2, "..."), (3, "..."), (1, ""), (0, "x"), (4, "…")])
def test_truncate(spark, s, most, suffix):
    raw, tail = s.encode(), suffix.encode()
    if most <= 0 or len(raw) <= most:
        want = s
    elif len(tail) >= most:
        want = tail[:most].decode(errors="ignore")
    else:
        want = raw[: most - len(tail)].decode(errors="ignore") + suffix
    assert one(spark, text.truncate(F.lit(s), most, suffix)) == want


def test_colours_and_json(spark):
    lines = [one(spark, text.highlight_line(F.lit("x"), F.lit(s))) for s in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")]
    assert all(x.endswith("\x1b[0m") for x in lines) and len(set(lines)) == 4 and lines[3] == lines[4]
    assert one(spark, text.highlight_line(F.lit("x"), F.lit("INFO"), False)) == "x"
    assert one(spark, text.highlight_severity(F.lit("INFO"))) == "\x1b[1m\x1b[36mINFO\x1b[0m"
    ts = F.lit("2024-01-15 10:00:00").cast("timestamp")
    assert one(spark, text.to_json(ts, F.lit("ERROR"), F.lit('disk "full"'))) == '{"timestamp":"2024-01-15T10:00:00Z","severity":"ERROR","message":"disk \\"full\\""}'
    assert '"2024-01-15T12:00:00+02:00"' in one(spark, text.to_json(ts, F.lit("INFO"), F.lit("x"), F.lit("+02:00")))
    assert '"2024-01-15T08:30:00-01:30"' in one(spark, text.to_json(ts, F.lit("INFO"), F.lit("x"), F.lit("-01:30")))
    assert [text.parse_format(x) for x in ("", "raw", "Raw", "JSON")] == ["raw", "raw", "raw", "json"]
    with pytest.raises(ValueError):
        text.parse_format("jSON")
