"""Small results for people: a page, pictures as SVG. Only the few rows that are shown reach the driver."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from datetime import datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENT = {"dist_from_pivot", "risk_pct", "impulse_gain", "base_depth", "gap", "extension", "run_gain"}
STYLE = "body{font:15px system-ui;margin:2rem}table{border-collapse:collapse}td,th{padding:.3rem .7rem;border-bottom:1px solid #ddd;text-align:right}.tile{display:inline-block;padding:.8rem 1.2rem;margin:.3rem;background:#f3f4f6;border-radius:6px}.tile b{display:block;font-size:1.4rem}img{max-width:420px}"
UP, DOWN, QUIET = "#2a7d4f", "#b3413a", "#8a8f98"


def shown(name: str, value) -> str:
    """A cell, escaped."""
    if value is None or value != value:
        return "–"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return escape(str(value))
    if name in PERCENT:
        return f"{value:.1%}"
    return f"{value:,.2f}" if isinstance(value, float) else f"{value:,}"


def tile(label: str, value, note: str = "") -> str:
    return f'<div class="tile">{escape(label)}<b>{escape(str(value))}</b>{escape(note)}</div>'


def picture(path: str | Path) -> str:
    """An image inside the page; nothing if the file is missing."""
    p = Path(path)
    if not p.is_file():
        return ""
    kind = {".svg": "svg+xml"}.get(p.suffix, p.suffix[1:])
    return f'<img alt="{escape(p.stem)}" src="data:image/{kind};base64,{base64.b64encode(p.read_bytes()).decode()}">'


def page(candidates: DataFrame, columns: list[str], title: str = "Scan", limit: int = 200, coverage: dict | None = None, actions: dict[str, int] | None = None, problems: Sequence[str] = (), errors: Sequence[tuple[str, str]] = (), charts: dict[str, str] | None = None) -> str:
    """A self-contained HTML page of the first `limit` candidates; what is beyond them is counted."""
    some = [c for c in columns if c in candidates.columns]
    best = F.max("score") if "score" in candidates.columns else F.lit(None)
    first, last = (F.min("date"), F.max("date")) if "date" in candidates.columns else (F.lit(None), F.lit(None))
    states = candidates.groupBy("state").agg(F.count(F.lit(1)).alias("n"), best.alias("best"), first.alias("first"), last.alias("last")).collect()
    counts = {r["state"]: r["n"] for r in states}
    total = sum(counts.values())
    rows = candidates.select(*some).limit(limit).toLocalIterator()
    body = "".join("<tr>" + "".join(f"<td>{shown(c, r[c])}</td>" for c in some) + f"<td>{picture(charts[r['symbol']]) if charts and r['symbol'] in charts else ''}</td></tr>" for r in rows)
    tiles = [tile("Candidates", total), *(tile(k, n) for k, n in sorted(counts.items()))]
    if scores := [r["best"] for r in states if r["best"] is not None]:
        tiles.append(tile("Best score", max(scores)))
    if days := [d for r in states for d in (r["first"], r["last"]) if d is not None]:
        tiles.append(tile("Bars of", max(days), f"from {min(days)}" if min(days) != max(days) else ""))
    if coverage:
        tiles.append(tile("Symbols healthy", coverage.get("symbols_healthy", 0), f"{coverage.get('total_rows', 0):,} bars"))
    tiles += [tile(k, n, "symbols") for k, n in sorted((actions or {}).items())]
    trouble = "".join(f"<li>{escape(x)}</li>" for x in [*problems, *(f"{s}: {e}" for s, e in errors)])
    note = "<p>No candidates passed the filters.</p>" if not total else f"<p>The best {limit} of {total}; the CSV has all.</p>" if total > limit else ""
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>"
        f"<p>{datetime.now():%Y-%m-%d %H:%M}</p>{''.join(tiles)}<ul>{trouble}</ul>{note}<table><tr>{''.join(f'<th>{escape(c)}</th>' for c in some)}<th></th></tr>{body}</table></body></html>"
    )


class Plot:
    """An SVG drawing with a linear scale on either axis."""

    def __init__(self, x: tuple[float, float], y: tuple[float, float], width: int = 900, height: int = 480, margin: int = 50) -> None:
        self.x, self.y, self.width, self.height, self.margin = x, y, width, height, margin
        self.parts: list[str] = []

    def at(self, x: float, y: float) -> tuple[float, float]:
        scale = lambda v, a, b: (v - a) / ((b - a) or 1)
        return round(self.margin + scale(x, *self.x) * (self.width - 2 * self.margin), 1), round(self.height - self.margin - scale(y, *self.y) * (self.height - 2 * self.margin), 1)

    def line(self, points: list[tuple[float, float]], colour: str, width: float = 1.2, dashed: bool = False) -> None:
        if points:
            path = " ".join(f"{a},{b}" for a, b in (self.at(*p) for p in points))
            self.parts.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="{width}"{" stroke-dasharray=\'5 4\'" if dashed else ""}/>')

    def box(self, a: tuple[float, float], b: tuple[float, float], colour: str, opacity: float = 1.0) -> None:
        (x0, y0), (x1, y1) = self.at(*a), self.at(*b)
        self.parts.append(f'<rect x="{min(x0, x1)}" y="{min(y0, y1)}" width="{max(abs(x1 - x0), 1)}" height="{max(abs(y1 - y0), 0.5)}" fill="{colour}" fill-opacity="{opacity}"/>')

    def text(self, x: float, y: float, words: str, colour: str = "#333") -> None:
        a, b = self.at(x, y)
        self.parts.append(f'<text x="{a}" y="{b}" font-size="12" font-family="sans-serif" fill="{colour}">{escape(words)}</text>')

    def mark(self, x: float, y: float, colour: str) -> None:
        a, b = self.at(x, y)
        self.parts.append(f'<circle cx="{a}" cy="{b}" r="5" fill="none" stroke="{colour}" stroke-width="2"/>')

    def save(self, path: str | Path, title: str) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        head = f'<text x="{self.margin}" y="22" font-size="16" font-family="sans-serif">{escape(title)}</text>'
        path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {self.width} {self.height}"><rect width="100%" height="100%" fill="#fff"/>{head}{"".join(self.parts)}</svg>')
        return path


def chart(rows: list, signal: dict, path: str | Path) -> Path:
    """Bars around a signal with its averages, levels, base, fill and exit."""
    rows = sorted((r.asDict() if hasattr(r, "asDict") else r for r in rows), key=lambda r: r["bar"])
    x = [r["bar"] for r in rows]
    low, high = min(r["low"] for r in rows), max(r["high"] for r in rows)
    plot = Plot((x[0] - 1, x[-1] + 1), (low - 0.25 * (high - low), high + 0.05 * (high - low)))
    if signal.get("base_len") and signal.get("pivot") and signal.get("base_low"):
        plot.box((signal["bar"] - signal["base_len"], signal["base_low"]), (signal["bar"], signal["pivot"]), "#4a78c2", 0.12)
    most = max(r["volume"] for r in rows) or 1
    for r in rows:
        colour = UP if r["close"] >= r["open"] else DOWN
        plot.box((r["bar"] - 0.3, plot.y[0]), (r["bar"] + 0.3, plot.y[0] + 0.2 * (high - low) * r["volume"] / most), QUIET, 0.5)
        plot.line([(r["bar"], r["low"]), (r["bar"], r["high"])], colour)
        plot.box((r["bar"] - 0.3, r["open"]), (r["bar"] + 0.3, r["close"]), colour)
    for name, colour in (("ma_fast", "#4a78c2"), ("ma_mid", "#c28a2c"), ("ma_slow", "#7a5ab5")):
        plot.line([(r["bar"], r[name]) for r in rows if r.get(name) is not None], colour)
    for name in ("pivot", "entry", "stop", "target_2r"):
        if signal.get(name) is not None:
            plot.line([(x[0], signal[name]), (x[-1], signal[name])], QUIET, 1, True)
            plot.text(x[-1] - 4, signal[name], name)
    bar_of = {str(r["date"]): r["bar"] for r in rows if r.get("date")}
    for day, price, colour in (("fill_date", "fill", UP), ("exit_date", "exit_price", DOWN)):
        if signal.get(day) and str(signal[day]) in bar_of and signal.get(price) is not None:
            plot.mark(bar_of[str(signal[day])], signal[price], colour)
    told = [signal["symbol"], signal.get("setup"), signal.get("date"), signal.get("outcome"), f"{signal['r_multiple']:+.1f} R" if signal.get("r_multiple") is not None else None]
    return plot.save(path, " ".join(str(t) for t in told if t))


def equity_chart(curve: list, path: str | Path) -> Path | None:
    """Equity and, below, its drawdown; None without a curve."""
    if not curve:
        return None
    curve = sorted(curve, key=lambda r: r["date"])
    x = [r["date"].toordinal() for r in curve]
    values = [r["equity"] for r in curve]
    low, high = min(values), max(values)
    span = (high - low) or 1
    plot = Plot((x[0], x[-1]), (low - 0.4 * span, high + 0.05 * span))
    plot.line(list(zip(x, values, strict=True)), UP, 1.6)
    deepest = min(r["drawdown"] or 0 for r in curve) or -1
    floor = low - 0.1 * span
    plot.line([(a, floor - 0.25 * span * (r["drawdown"] or 0) / deepest) for a, r in zip(x, curve, strict=True)], DOWN)
    plot.text(x[0], high, f"{values[-1]:,.0f}")
    plot.text(x[0], floor, f"drawdown, at worst {deepest:.1%}", DOWN)
    return plot.save(path, f"Equity, {curve[0]['date']} to {curve[-1]['date']}")


def contact_sheet(paths: list[str | Path], path: str | Path, columns: int = 2, width: int = 900, height: int = 480) -> Path | None:
    """Pictures side by side as one; None without any."""
    if not paths:
        return None
    inner = "".join(f'<svg x="{i % columns * width}" y="{i // columns * height}" width="{width}" height="{height}">{Path(p).read_text()}</svg>' for i, p in enumerate(paths))
    path = Path(path)
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {columns * width} {-(-len(paths) // columns) * height}">{inner}</svg>')
    return path
