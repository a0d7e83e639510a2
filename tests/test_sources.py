import pytest

from vetspan.operators import evidence
from vetspan.plans import carriers
from vetspan.sources import files, schemas


def test_allowlist(spark, tmp_path):
    path = tmp_path / "domains"
    path.write_text("# trusted\nExample.com\n\nexample.com # twice\nb.test\n")
    assert {r.domain for r in files.read_domain_allowlist(spark, str(path)).collect()} == {"example.com", "b.test"}
    path.write_text("not a domain\n")
    with pytest.raises(ValueError):
        files.read_domain_allowlist(spark, str(path))


def test_aliases(spark, tmp_path):
    path = tmp_path / "aliases"
    path.write_text("a: b\nb: c\nx: y\ny: x\nm: one, two\n# no: no\n")
    aliases = files.read_aliases(spark, str(path))
    names = spark.createDataFrame([("a",), ("x",), ("m",)], "name string")
    assert {tuple(r) for r in files.alias_owner(aliases, names).collect()} == {("a", "c"), ("m", "m")}


def test_archive(spark, tmp_path):
    day = 86_400_000
    rows = [(i, i * day, bytes([65 + i]) * 10) for i in range(3)]
    folder = str(tmp_path / "archive")
    files.write_archive(spark.createDataFrame(rows, "id long, at_ms long, content binary"), folder)
    one = files.read_archived(spark, folder, 1, day, 4).collect()
    assert [(r.id, bytes(r.content), r.truncated) for r in one] == [(1, b"BBBB", True)]
    days = files.archive_size(spark, folder)
    assert {(r.d, r.bytes) for r in days.collect()} == {("01", 10), ("02", 10), ("03", 10)}
    assert [r.d for r in files.expired_days(days, 2 * day).orderBy("d").collect()] == ["01", "02"]


def test_schemas():
    assert set(schemas.TABLES) >= {"activity", "ip_reputation", "correspondents"}
    for name in schemas.TABLES:
        assert schemas.schema(name).names
    with pytest.raises(ValueError):
        schemas.migrate_activity(None, 7)


def test_visible_html():
    html = "<html><head><title>t</title></head><body><p>a <b>b</b></p><script>x</script><a href='https://e.test/'>go</a><a href='javascript:x'>no</a><style>y"
    text, links, incomplete = evidence.visible_html(html)
    assert text.split() == ["a", "b", "[go](https://e.test/)no"] and links == ["https://e.test/"] and incomplete
    assert evidence.visible_html(None) == (None, None, False)


def test_message_parts(spark):
    raw = b"Content-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--b--\r\n"
    parts = evidence.message_parts(spark.createDataFrame([(1, raw), (2, None)], "id long, content binary"))
    assert {(r.id, r.content_type) for r in evidence.chosen_body(parts).collect()} == {(1, "text/html"), (2, "text/plain")}


def test_pushdown(spark, data):
    plan = carriers.rejections(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_clerk" not in plan
