"""Command line: ``run``, ``validate``, ``mine`` and ``merge``. Exit codes: 0 done, 1 failed, 2 wrong input."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from larkspan.plans import builder, config

log = logging.getLogger("larkspan")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspan")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        sub.add_parser(name).add_argument("config")
    mine = sub.add_parser("mine")
    mine.add_argument("audio", help="a path or glob of WAV files")
    mine.add_argument("model", help="an ONNX file")
    mine.add_argument("output")
    mine.add_argument("--threshold", type=float, default=0.7)
    merge = sub.add_parser("merge")
    merge.add_argument("training")
    merge.add_argument("new")
    merge.add_argument("output")
    merge.add_argument("--backup", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    try:
        if given.command in ("run", "validate"):
            read = config.load(given.config)
            if given.command == "run":
                builder.run(SparkSession.builder.getOrCreate(), read).summary().show()
            return 0
        spark = SparkSession.builder.getOrCreate()
        if given.command == "mine":
            return _mine(spark, given)
        if not given.new.endswith(".jsonl"):
            log.error("the new manifest must be a .jsonl file")
            return 2
        from larkspan.sources.jsonl import read_manifest

        for r in builder.append(spark, read_manifest(spark, given.training), given.new, given.output, given.backup).limit(5).collect():
            log.warning(r["message"])
        return 0
    except config.ConfigError as problem:
        log.error("%s", problem)
        return 2
    except Exception as problem:
        log.error("%s", str(problem).splitlines()[0] if str(problem) else type(problem).__name__)
        return 1


def _mine(spark: SparkSession, given: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from larkspan.sources.jsonl import write_manifest
    from larkspan.sources.scoring import onnx_model
    from larkspan.sources.wav import read_audio

    with open(given.model, "rb") as f:
        content = f.read()
    try:
        files = read_audio(spark, given.audio)
    except AnalysisException:
        log.error("no file matches %s", given.audio)
        return 2
    signals = files.select(F.col("path").alias("signal_id"), "audio")
    clips = builder.mine(signals, lambda: onnx_model(content), given.threshold)
    write_manifest(builder.mined_manifest(clips, given.threshold), given.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
