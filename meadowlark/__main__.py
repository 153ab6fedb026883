"""Commands over report files.

    python -m meadowlark extract ZIP_FOLDER [-o elk_pdfs]
    python -m meadowlark harvest TEXT... [OUTPUT]
    python -m meadowlark population TEXT... [OUTPUT]
    python -m meadowlark combine --harvest-dir DIR --population-dir DIR [-o output]
    python -m meadowlark reports --harvest-dir DIR --population-dir DIR [-o output]

``combine`` reads the per-year JSON files that ``harvest`` and ``population`` write; ``reports`` goes from page text to the
documents in one run. Page text is one ``.txt`` file per report, pages parted by form feeds. Without a command it is
``reports``.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from meadowlark.operators import harvest, population
from meadowlark.plans import reports
from meadowlark.session import local_session
from meadowlark.sources import archives
from meadowlark.sources.json_files import exists
from meadowlark.sources.pages import PAGES, read_page_files, read_page_text

COMMANDS = ("extract", "harvest", "population", "combine", "reports")
#: What a report's page text is called.
ENDING = ".txt"


def _extract(spark: SparkSession, argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="meadowlark extract")
    parser.add_argument("zip_folder")
    parser.add_argument("-o", "--output", default="elk_pdfs")
    args = parser.parse_args(argv)
    counts, broken = archives.extract(spark, args.zip_folder, args.output)
    for row in broken.toLocalIterator():
        print(f"Skipped: {row['zip_path']} {row['member'] or ''}: {row['error']}")
    found = {r["category"]: r["members"] for r in counts.collect()}
    for category in ("harvest_reports", "population_estimates", "other_elk", "skipped"):
        print(f"{category}: {found.get(category, 0)}")


def split_arguments(names: list[str]) -> tuple[list[str], str]:
    """Report files and the output folder: a last name that is no report file; other names that are none are left out."""
    folder = names.pop() if names and not names[-1].lower().endswith(ENDING) else "."
    return [n for n in names if n.lower().endswith(ENDING)], folder


def _parse(spark: SparkSession, kind: str, argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog=f"meadowlark {kind}")
    parser.add_argument("names", nargs="+", help="report files in order, then the output folder")
    files, folder = split_arguments(parser.parse_args(argv).names)
    if not files:
        raise SystemExit(f"no {ENDING} files given")
    pages = read_page_files(spark, files)
    report = (harvest if kind == "harvest" else population).parse_reports(pages)
    made = (reports.write_harvest if kind == "harvest" else reports.write_population)(report, folder)
    for row in report.quarantine.orderBy("file").toLocalIterator():
        print(f"Failed: {row['file']}: {row['reason']}")
    for path in made:
        print(f"Wrote: {path}")
    done = (report.files if kind == "harvest" else report.totals).count()
    print(f"Done. Processed {done} file(s).")


def _folders(command: str, argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog=f"meadowlark {command}")
    parser.add_argument("--harvest-dir", required=True)
    parser.add_argument("--population-dir", required=True)
    parser.add_argument("-o", "--output-dir", "--output", default="output")
    parser.add_argument("--state", default="")
    parser.add_argument("--source", default="")
    return parser.parse_args(argv)


def _combine(spark: SparkSession, args: argparse.Namespace) -> reports.Summary:
    globs = [f"{args.harvest_dir}/*_harvest_*.json", f"{args.population_dir}/*_population_*.json"]
    try:
        tables = reports.combined_files(spark, *globs)
    except FileNotFoundError as why:
        raise SystemExit(str(why)) from why
    return reports.write_documents(tables, args.output_dir, str(date.today()), args.state, args.source)


def _reports(spark: SparkSession, args: argparse.Namespace) -> reports.Summary:
    def pages(folder: str) -> DataFrame:
        return read_page_text(spark, folder) if exists(spark, f"{folder}/*") else spark.createDataFrame([], PAGES)

    if not any(exists(spark, f"{folder}/*") for folder in (args.harvest_dir, args.population_dir)):
        raise SystemExit("no reports in either folder")
    return reports.write_all(pages(args.harvest_dir), pages(args.population_dir), args.output_dir, str(date.today()), args.state, args.source)


def main(argv: list[str] | None = None) -> None:
    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv.pop(0) if argv and argv[0] in COMMANDS else "reports"
    spark = local_session()
    if command == "extract":
        _extract(spark, argv)
    elif command in ("harvest", "population"):
        _parse(spark, command, argv)
    else:
        done = (_combine if command == "combine" else _reports)(spark, _folders(command, argv))
        print("\n".join(done.lines()))


if __name__ == "__main__":
    main()
