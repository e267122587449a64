"""Command line: python -m laurel.cli person|country FOLDER TEXT [filters] [--json]"""

from __future__ import annotations

import argparse
import json
import sys

from laurel.plans import answers, country, model, person
from laurel.session import session


def rendered(answer: answers.Answer, as_json: bool, limit: int) -> str:
    """An answer as JSON or as text; its tables are small by their own limits, and are cut at `limit` rows."""
    tables = {name: [row.asDict(recursive=True) for row in df.limit(limit).collect()] for name, df in answer.tables.items()}
    if as_json:
        return json.dumps({"status": answer.status.value, "parameters": answer.parameters, **tables}, default=str, ensure_ascii=False, indent=2)
    lines = [f"status: {answer.status.value}"]
    for name, rows in tables.items():
        lines.append(f"\n[{name}] {len(rows)} rows")
        lines += [" | ".join("" if v is None else str(v) for v in row.values()) for row in rows]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="laurel", description=__doc__)
    parser.add_argument("what", choices=["person", "country"])
    parser.add_argument("folder")
    parser.add_argument("text")
    for name in ("sport", "season", "medal", "country"):
        parser.add_argument(f"--{name}")
    for name in ("year", "first-year", "last-year", "limit"):
        parser.add_argument(f"--{name}", type=int)
    parser.add_argument("--exact", action="store_true")
    parser.add_argument("--document", action="store_true", help="the document dialect")
    parser.add_argument("--json", action="store_true")
    o = parser.parse_args(argv)
    spark = session("laurel-cli")
    tables = model.load(spark, o.folder)
    try:
        if o.what == "country":
            answer = country.results(tables, o.text, o.year, o.season, o.sport, o.limit, "document" if o.document else "relational")
        elif o.document:
            answer = person.document_search(tables, o.text, answers.clamped(o.limit, 25, 500))
        else:
            answer = person.history(tables, o.text, o.sport, o.country, o.year, o.first_year, o.last_year, o.medal, o.season, exact=o.exact, most=o.limit)
    except answers.ParameterError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    print(rendered(answer, o.json, 1000))
    return 0


if __name__ == "__main__":
    sys.exit(main())
