"""Command line: python -m attestor.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from .errors import CodingError
from .plans import report
from .plans.project import Project, code_tasks
from .sources import settings, stores


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attestor")
    top.add_argument("--project", default=".")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [c := sub.add_parser(name), *[c.add_argument(*a, **k) for a, k in flags]]
    flag = lambda *a, **k: (a, k)
    on = {"action": "store_true"}
    add("init", flag("--backend", default="recorded"), flag("--force", **on))
    add("load", flag("file"), flag("--text-col", default="text"), flag("--id-col"))
    add("splits", flag("action", choices=("show", "reset")), flag("--yes", **on))
    add("codebook", flag("action", choices=("check",)))
    add("try", flag("--n", type=int, default=50), flag("--codes", nargs="*"), flag("--recorded"), flag("--yes", **on))
    add("gold", flag("--n", type=int), flag("--coder", default="coder_1"), flag("--overlap", type=int, default=0), flag("--enrich"))
    add("check", flag("--alpha", type=float), flag("--delta", type=float), flag("--resamples", type=int, default=2000), flag("--recorded"), flag("--yes", **on))
    add("run", flag("--codes", nargs="*"), flag("--yes", **on), flag("--retry-failed", **on), flag("--recorded"))
    add("review", flag("--coder", default="coder_1"), flag("--limit", type=int))
    add("export", flag("--format", default="csv"), flag("--no-report", **on), flag("--no-chart", **on), flag("--resamples", type=int, default=2000))
    add("compare", flag("--backends", nargs="+", required=True), flag("--resamples", type=int, default=500), flag("--recorded"), flag("--yes", **on))
    add("purge", flag("--gold", **on), flag("--review", **on), flag("--cache", **on), flag("--all", **on), flag("--yes", **on))
    return top


def _scorer(project: Project, recorded: str | None, name: str | None = None):
    from .operators import scoring

    b = project.settings.backend
    name = "recorded" if recorded else name or b.name
    if name == "recorded":
        where = recorded or b.endpoint
        if not where:
            return scoring.backend(name)  # says what is missing
        rows, model = stores.read_recorded(project.spark, where)
        return scoring.RecordedBackend(model_version=model, recorded=rows)
    given = {"url": b.endpoint} if b.endpoint else {}
    return scoring.backend(name, retries=project.settings.engine.max_retries, **given, **({"model_version": b.model} if b.model else {}))


#: Tasks that a session at the terminal is given; the next session goes on after them.
SESSION = 500


def _tasks(project: Project, pairs, coder: str, log, visible: bool, limit: int | None = None) -> int:
    some = pairs.limit(min(limit or SESSION, SESSION))
    rows = some.join(project.items().select("item_id", "text"), "item_id").collect()
    got = code_tasks([r.asDict() for r in rows], ask=input, show_probability=visible)
    log.append([{**g, "coder": coder} for g in got])
    return len(got)


def execute(args: argparse.Namespace, spark) -> object:
    if args.command == "init":
        Project.create(spark, args.project, backend=args.backend, force=args.force)
        return "created"
    project = Project(spark, args.project)
    settings.load_env(project.path(".env"))
    if args.command == "load":
        return project.load(args.file, text_column=args.text_col, id_column=args.id_col)
    if args.command == "splits":
        if args.action == "reset":
            if not args.yes:
                raise CodingError("this discards the calibration too", hint="--yes")
            project.reset_splits()
            return "reset"
        return {r["split"]: r["count"] for r in project.splits().groupBy("split").count().collect()}
    if args.command == "codebook":
        book = project.codebook()
        return {"codes": {c.code_id: c.hash for c in book.codes}, "hash": book.hash, "warnings": settings.definition_warnings(book)}
    if args.command == "try":
        return [r.asDict() for r in project.try_codes(_scorer(project, args.recorded), n=args.n, codes=args.codes, approved=args.yes).collect()]
    if args.command == "gold":
        from .operators import gold

        plan = project.plan_gold(n=args.n, overlap=args.overlap, code=args.enrich)
        pairs = gold.open_tasks(plan.crossJoin(project.codebook().table(spark).select("code_id")), gold.coded_pairs(project.gold().read(), args.coder))
        return _tasks(project, pairs, args.coder, project.gold(), False)
    if args.command == "check":
        return project.check(_scorer(project, args.recorded), alpha=args.alpha, delta=args.delta, resamples=args.resamples, approved=args.yes)
    if args.command == "run":
        return project.run(_scorer(project, args.recorded), codes=args.codes, retry_failed=args.retry_failed, approved=args.yes).count()
    if args.command == "review":
        return _tasks(project, project.review_queue(args.limit), args.coder, project.reviews(), True, args.limit)
    if args.command == "export":
        return project.export(fmt=args.format, with_report=not args.no_report, with_chart=not args.no_chart, resamples=args.resamples)
    if args.command == "compare":
        return [r.asDict() for r in project.compare({b: _scorer(project, args.recorded if b == "recorded" else None, b) for b in args.backends}, resamples=args.resamples, approved=args.yes).collect()]
    if not args.yes:
        raise CodingError("this deletes data", hint="--yes")
    project.purge(what=("gold", "review", "cache", "runs", "out") if args.all else tuple(n for n in ("gold", "review", "cache") if getattr(args, n)))
    return "purged"


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("attestor").getOrCreate()
    try:
        got = execute(args, spark)
    except CodingError as e:
        print(report.error_envelope(args.command, e) if args.json else f"{e}" + (f" ({e.hint})" if e.hint else ""), file=sys.stdout if args.json else sys.stderr)
        return int(e.exit_code)
    print(report.envelope(args.command, got) if args.json else report.check_table(got) if args.command == "check" else got)
    return 0


if __name__ == "__main__":
    sys.exit(main())
