"""A small PDF writer: cover, analysis, and a listing of bounded length."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from .exports import COLUMNS, UNTITLED, now_text, rows_to_export, stats_record

ROWS_PER_PAGE, MAX_PAGES = 48, 512
TOP, STEP, LEFT = 714, 14, 50


def pdf_text(text: str, most: int | None = None) -> str:
    """Text of a string object: ASCII, escaped, cut with dots."""
    if most is not None and len(text) > most:
        text = text[: most - 3] + "..."
    text = "".join(c if 32 <= ord(c) < 127 else "?" for c in text)
    return text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")


class Document:
    """Pages of text lines and filled boxes in one font."""

    def __init__(self):
        self.pages: list[str] = []

    def page(self, items: list[str]) -> None:
        self.pages.append("\n".join(items))

    @staticmethod
    def line(x: float, y: float, size: int, text: str, most: int | None = None) -> str:
        return f"BT /F1 {size} Tf {x} {y} Td ({pdf_text(text, most)}) Tj ET"

    @staticmethod
    def box(x: float, y: float, width: float, height: float, color: str = "0.2 0.6 1.0") -> str:
        return f"{color} rg {x} {y} {width:.2f} {height:.2f} re f 0 0 0 rg"

    def save(self, path: str | Path) -> None:
        kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(self.pages)))
        objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(self.pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
        for i, content in enumerate(self.pages):
            objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
            objects.append(f"<< /Length {len(content)} >>\nstream\n{content}\nendstream")
        out, places = b"%PDF-1.4\n", []
        for i, body in enumerate(objects, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n{body}\nendobj\n".encode("ascii")
        start = len(out)
        out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode()
        out += b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
        out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
        Path(path).write_bytes(out)


def write_pdf(history: DataFrame, path: str | Path, analysis: DataFrame | None = None, hours: DataFrame | None = None, categories: DataFrame | None = None, now: datetime | None = None) -> int:
    """Cover, an analysis page where ``analysis`` is given, and rows up to MAX_PAGES; gives the number of pages."""
    s, doc, line, box = stats_record(history), Document(), Document.line, Document.box
    items = [line(LEFT, 700, 24, "Browser History Report"), line(LEFT, 670, 11, f"Generated {now_text(now)}")]
    for i, (key, value) in enumerate(s.items()):
        items.append(line(LEFT, 630 - 20 * i, 12, f"{key.replace('_', ' ').capitalize()}: {value}", 90))
    doc.page(items)
    if analysis is not None:
        a = analysis.first()
        items = [line(LEFT, 720, 18, "Analysis")]
        for i, name in enumerate(("insight_primary", "insight_focus", "insight_habit", "insight_recommendation")):
            items.append(line(LEFT, 690 - 18 * i, 10, a[name].replace("—", "-"), 100))
        items += [line(LEFT, 600, 10, f"Productivity {a['productivity_score']}/100"), box(LEFT, 585, 4 * a["productivity_score"], 8)]
        if categories is not None:
            rows = sorted(categories.collect(), key=lambda r: -r["total_visits"])
            most = max((r["total_visits"] for r in rows), default=1) or 1
            for i, r in enumerate(rows[:12]):
                items += [line(LEFT, 560 - 16 * i, 9, f"{r['category']} ({r['total_visits']})"), box(200, 558 - 16 * i, 300 * r["total_visits"] / most, 8)]
        if hours is not None:
            bars = {r["hour"]: r["visits"] for r in hours.collect()}
            most = max(bars.values(), default=1) or 1
            items += [box(LEFT + 20 * h, 120, 14, 150 * bars.get(h, 0) / most) for h in range(24)]
            items += [line(LEFT + 20 * h, 105, 7, str(h)) for h in range(24)]
        doc.page(items)
    shown = rows_to_export(history).orderBy("pos").limit(ROWS_PER_PAGE * (MAX_PAGES - len(doc.pages))).select(*COLUMNS).toLocalIterator()
    items, n = [], 0
    for r in shown:
        items.append(line(LEFT, TOP - STEP * (n % ROWS_PER_PAGE), 8, f"{(r['title'] or UNTITLED)[:40]} | {r['url'][:60]} | {r['visit_count']} | {r['last_visit_time']}", 130))
        n += 1
        if n % ROWS_PER_PAGE == 0:
            doc.page(items)
            items = []
    if items:
        doc.page(items)
    doc.save(path)
    return len(doc.pages)
