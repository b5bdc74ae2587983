"""Command line: ``boards`` publishes the boards, ``export`` writes the data products."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from boardwalk import schemas
from boardwalk.plans import boards
from boardwalk.session import build_session
from boardwalk.sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m boardwalk")
    top.add_argument("--master", help="Spark master; by default that of spark-submit")
    commands = top.add_subparsers(dest="command", required=True)

    publish = commands.add_parser("boards", help="ranking, sleeper and bust boards")
    publish.add_argument("players", help="projections, a JSON array")
    publish.add_argument("gaps", help="value gaps, a JSON array")
    publish.add_argument("site", help="output folder, one part per board")

    export = commands.add_parser("export", help="season points, value over replacement, scarcity")
    export.add_argument("stats", help="season stat lines, Parquet")
    export.add_argument("players", help="projections, a JSON array")
    export.add_argument("roster", help="roster configuration, one JSON document")
    export.add_argument("out", help="output folder")
    export.add_argument("--seasons", type=int, default=5)
    export.add_argument("--scoring", choices=sorted(boards.RECEPTION_POINTS), default="half_ppr")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = build_session(f"boardwalk-{args.command}", master=args.master)
    if args.command == "boards":
        now = datetime.now(UTC).replace(tzinfo=None)
        report = boards.publish(spark, args.players, args.gaps, args.site, now)
        print(f"{report['n_active']} active players, {report['n_gaps']} value gaps")
        print(f"wrote {report['n_rows']} board rows to {args.site}")
        return
    boards.export_static(
        spark.read.parquet(args.stats),
        readers.read_records(spark, args.players, schemas.PROJECTIONS),
        readers.read_roster_config(spark, args.roster),
        args.out,
        args.seasons,
        args.scoring,
    )
    print(f"wrote the data products to {args.out}")


if __name__ == "__main__":
    main()
