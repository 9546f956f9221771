"""Command line: one run over the sites of a configuration.

    python -m pagedelta CONFIG STORE [--publish FOLDER] [--log-level LEVEL]
"""

from __future__ import annotations

import argparse
import logging
from datetime import datetime, timezone

from .config import load_config
from .operators.run import crawl, run_summary
from .session import session
from .sources.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagedelta")
    parser.add_argument("config", help="settings and sites, YAML or JSON")
    parser.add_argument("store", help="folder of the versioned store")
    parser.add_argument("--publish", help="folder for the JSON of sites and changes")
    parser.add_argument("--log-level", default="info", choices=("debug", "info", "warning", "error"))
    args = parser.parse_args(argv)
    log = logging.getLogger("pagedelta")
    log.setLevel(args.log_level.upper())
    shown = logging.StreamHandler()
    shown.setFormatter(logging.Formatter("{levelname:<7} {message}", style="{"))
    log.addHandler(shown)
    config = load_config(args.config)
    spark = session("pagedelta")
    store = Store(spark, args.store)
    run = crawl(store, config, datetime.now(timezone.utc).replace(tzinfo=None))
    for r in run_summary(store.load_changes().filter(f"run = {run}"), store.load_sites()).collect():  # a row for each site
        log.info("%s: %d changes", r["name"], r["n_changes"])
    errors = store.load_errors().filter(f"run = {run}")
    for r in errors.groupBy("domain", "stage", "fatal").count().orderBy("domain", "stage").collect():  # a row for each site and stage
        log.warning("%s: %d errors in %s%s", r["domain"], r["count"], r["stage"], ", site left as it was" if r["fatal"] else "")
    if args.publish:
        store.publish(args.publish, config.settings.max_changes_history)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
