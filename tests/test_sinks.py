import json

from histlab.cli import main
from histlab.operators import rules
from histlab.sinks import exports, pdf
from histlab.sources.importer import auto_import


def test_json_and_csv_round_trip(spark, history10, tmp_path):
    assert exports.write_json(history10, tmp_path / "o.json") == 10
    data = json.loads((tmp_path / "o.json").read_text())
    assert data["stats"]["total_visits"] == 316 and data["data"][7]["title"] == "numpy · PyPI" and data["error"] is None
    assert exports.write_csv(history10, tmp_path / "o.csv") == 10
    raw = (tmp_path / "o.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfurl,title,visit_count") and raw.count(b"\r\n") == 11
    for name in ("o.json", "o.csv"):
        back = {r["url"]: (r["title"], r["visit_count"], r["typed_count"], r["last_visit_time"]) for r in auto_import(spark, str(tmp_path / name)).collect()}
        assert back == {r["url"]: (r["title"], r["visit_count"], r["typed_count"], r["last_visit_time"]) for r in history10.collect()}


def test_parts(spark, history10, tmp_path):
    exports.write_csv_parts(history10, str(tmp_path / "csv"))
    exports.write_json_lines(history10, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 10 and spark.read.json(str(tmp_path / "json")).count() == 10


def test_reports(history10, tmp_path):
    cats = rules.category_stats(rules.categorize(history10))
    exports.write_markdown(history10, tmp_path / "o.md", cats)
    text = (tmp_path / "o.md").read_text()
    assert "| Streaming | 2 | 74 | open.spotify.com |" in text and "**Categorized:** 8 | **Uncategorized:** 2" in text
    exports.write_html(history10, tmp_path / "o.html", cats)
    assert "sortTable" in (tmp_path / "o.html").read_text()
    assert pdf.write_pdf(history10, tmp_path / "o.pdf") == 2
    raw = (tmp_path / "o.pdf").read_bytes()
    assert raw.startswith(b"%PDF-1.4") and raw.rstrip().endswith(b"%%EOF")
    assert exports.markdown_escape("a|b*c", 3) == r"a\|b..." and exports.csv_field('a"b') == '"a""b"'
    assert pdf.pdf_text("(ü)\\") == "\\(?\\)\\\\"


def test_extension_export(spark, tmp_path):
    df = spark.sql("select 'https://a.com/' url, 't' title, timestamp'2026-01-01 00:00:00' ts, true incognito")
    assert exports.write_extension_json(df, tmp_path / "e.json") == 1
    data = json.loads((tmp_path / "e.json").read_text())
    assert data["stats"]["total_incognito"] == 1 and auto_import(spark, str(tmp_path / "e.json")).first()["title"] == "[INCOGNITO] t"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "h.csv").write_text("url,title,visits,date\nhttps://github.com/a,Repo,5,2026-04-27T13:38:10Z\nhttps://cnn.com/,News,2,2026-04-27T13:40:00Z\n")
    (tmp_path / "rules.conf").write_text("[Mine]\ndomains = cnn.com\n")
    args = ["--no-db", "--import", str(tmp_path / "h.csv"), "--categorize", "--sessions", "--domains", "--rules", str(tmp_path / "rules.conf")]
    for form in ("json", "csv", "html", "markdown", "pdf"):
        args += [f"--{form}", str(tmp_path / f"out.{form}")]
    assert main(args, spark) == 0
    shown = capsys.readouterr().out
    assert "Development" in shown and "github.com" in shown and all((tmp_path / f"out.{f}").stat().st_size for f in ("json", "csv", "html", "markdown", "pdf"))
    assert main(["--no-db", "--import", str(tmp_path / "h.csv"), "--search", "domain:github.com"], spark) == 0
    assert "Repo" in capsys.readouterr().out
    assert main(["--no-db"], spark) == 0
