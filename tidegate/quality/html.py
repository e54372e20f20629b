"""Quality reports as HTML pages."""

from __future__ import annotations

from html import escape

from tidegate.quality.rules import QualityReport

_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em .8em;text-align:left}.card{display:inline-block;border:1px solid #999;padding:.6em 1.2em;margin-right:1em}.bad{color:#a00}.good{color:#070}"


def render(report: QualityReport) -> str:
    """A page with the sums and one line per rule; all values are escaped."""
    word = lambda ok: f"<span class='{'good' if ok else 'bad'}'>{'passed' if ok else 'failed'}</span>"
    cards = [("Result", word(report.passed)), ("Mean pass rate", f"{report.overall_pass_rate:.2%}"), ("Rules", len(report.results)), ("Below threshold", len(report.failing))]
    lines = "".join(
        f"<tr><td>{escape(r.field)}</td><td>{escape(r.rule)}</td><td>{r.passed}</td><td>{r.failed}</td><td>{r.pass_rate:.2%}</td><td>{r.threshold:.2%}</td><td>{word(r.meets_threshold)}</td><td>{escape(r.detail)}</td></tr>"
        for r in report.results
    )
    head = "".join(f"<th>{h}</th>" for h in ("Field", "Rule", "Passed", "Failed", "Pass rate", "Threshold", "Result", "Detail"))
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>Quality of {escape(report.dataset)}</title><style>{_STYLE}</style></head><body>"
        f"<h1>Quality of {escape(report.dataset)}</h1><p>{report.at.isoformat()}</p>"
        + "".join(f"<div class='card'><b>{k}</b><br>{v}</div>" for k, v in cards)
        + f"<h2>Rules</h2><table><tr>{head}</tr>{lines}</table></body></html>"
    )


def file_name(report: QualityReport) -> str:
    return f"quality-{report.dataset}-{report.at:%Y%m%dT%H%M%S}.html"
