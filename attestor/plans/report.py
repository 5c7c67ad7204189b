"""Markdown report, methods paragraph, terminal table and JSON of a check. Input is a handful of collected rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from ..errors import ValidationError


def number(x: float | None, digits: int = 2) -> str:
    return "–" if x is None else f"{x:.{digits}f}"


def percent(x: float | None) -> str:
    return "–" if x is None else f"{100 * x:.1f} %"


def markdown(head: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    line = lambda xs: "| " + " | ".join(map(str, xs)) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def check_table(checks: Sequence[dict]) -> str:
    rows = [(c["code_id"], c["verdict"], number(c["kappa"]), percent(c["coverage"]), c.get("reason") or "") for c in checks]
    widths = [max(len(str(r[k])) for r in [("code", "verdict", "kappa", "auto", "reason"), *rows]) for k in range(5)]
    lines = ["  ".join(str(x).ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in [("code", "verdict", "kappa", "auto", "reason"), *rows]]
    usable = sum(c["verdict"] in ("ok", "weak") for c in checks)
    return "\n".join([*lines, f"{usable} of {len(checks)} codes usable"])


def envelope(command: str, data: object) -> str:
    return json.dumps({"version": 1, "command": command, "ok": True, "data": data}, default=str, sort_keys=True)


def error_envelope(command: str, error: Exception) -> str:
    return json.dumps({"version": 1, "command": command, "ok": False, "error": type(error).__name__, "message": str(error), "hint": getattr(error, "hint", None), "exit_code": int(getattr(error, "exit_code", 1))}, sort_keys=True)


def decimate(points: Sequence[dict]) -> list[dict]:
    """About six points of each code's curve."""
    of: dict[str, list[dict]] = {}
    for p in points:
        of.setdefault(p["code_id"], []).append(p)
    return [p for rows in of.values() for p in rows[:: max(1, len(rows) // 6)]]


def methods_paragraph(*, n_items: int, n_gold: int, alpha: float, delta: float, backend: str, model: str, n_codes: int, usable: int) -> str:
    return (
        f"{n_items} texts were coded for {n_codes} categories. A random sample of {n_gold} texts was coded by people; one part fitted, for each category, an "
        f"abstention band whose error among accepted texts of each true class is at most {alpha:g} with confidence {1 - delta:g} (binomial tail tests, delta "
        f"shared over all bands), another part measured agreement with people on the finished data (Cohen's kappa). Probabilities came from {backend} ({model}). "
        f"{usable} of {n_codes} categories met the bar; texts outside the bands were left to people."
    )


def build_report(*, title: str, checks: Sequence[dict], selective: Sequence[dict] = (), labour: Sequence[dict] = (), note: dict | None = None, methods: str = "") -> str:
    """Verdicts, bands, diagnostics, curves, divergence of kappa and alpha, provenance."""
    parts = [f"# {title}", methods, "## Verdicts", markdown(["code", "verdict", "kappa", "automatic", "reason"], [(c["code_id"], c["verdict"], number(c["kappa"]), percent(c["coverage"]), c.get("reason") or "") for c in checks])]
    parts += ["## Bands", markdown(["code", "no below", "yes above", "error, yes", "error, no"], [(c["code_id"], number(c["t_lo"], 3), number(c["t_hi"], 3), percent(c.get("positive_risk")), percent(c.get("negative_risk"))) for c in checks])]
    parts += ["## Diagnostics", markdown(["code", "Brier", "ECE", "human kappa", "human alpha"], [(c["code_id"], number(c.get("brier"), 4), number(c.get("ece"), 4), number(c.get("human_kappa")), number(c.get("human_alpha"))) for c in checks])]
    if selective:
        parts += ["## Selective agreement", markdown(["code", "band", "coverage", "kappa", "accuracy", "prevalence"], [(p["code_id"], number(p["t_hi"], 3), percent(p["coverage"]), number(p["kappa"]), percent(p["accuracy"]), percent(p["prevalence"])) for p in decimate(selective)])]
    if labour:
        parts += ["## Reliability against labour", markdown(["code", "labour", "kappa"], [(p["code_id"], percent(p["labour"]), number(p["kappa"])) for p in decimate(labour)])]
    apart = [c for c in checks if c.get("human_kappa") is not None and c.get("human_alpha") is not None and abs(c["human_kappa"] - c["human_alpha"]) > 0.10]
    parts += [f"Note: kappa and alpha of the coders differ on {c['code_id']}; the classes are very uneven." for c in apart]
    parts += [c["advice"] for c in checks if c.get("advice")]
    if note:
        parts += ["## Provenance", "\n".join(f"- {k}: {v}" for k, v in sorted(note.items()))]
    return "\n\n".join(p for p in parts if p) + "\n"


def draw_labour_chart(points: Sequence[dict], baseline: Sequence[dict], path: str, title: str = "Reliability against human labour") -> None:
    try:
        from matplotlib import pyplot as plt
    except ImportError as e:
        raise ValidationError("charts need matplotlib") from e
    fig, ax = plt.subplots()
    for rows, label in ((points, "calibrated"), (baseline, "random checks")):
        held = sorted((r["labour"], r["kappa"]) for r in rows if r["kappa"] is not None)
        ax.plot([x for x, _ in held], [y for _, y in held], label=label)
    ax.set(xlabel="share coded by people", ylabel="kappa", title=title)
    ax.legend()
    fig.savefig(path, dpi=150)
    plt.close(fig)


def draw_reliability_diagram(bins: Sequence[dict], path: str, title: str = "Calibration") -> None:
    try:
        from matplotlib import pyplot as plt
    except ImportError as e:
        raise ValidationError("charts need matplotlib") from e
    fig, ax = plt.subplots()
    held = [b for b in bins if b["n"]]
    ax.plot([0, 1], [0, 1], linestyle=":")
    ax.plot([b["predicted"] for b in held], [b["observed"] for b in held], marker="o")
    ax.set(xlabel="predicted", ylabel="observed", title=title)
    fig.savefig(path, dpi=150)
    plt.close(fig)
