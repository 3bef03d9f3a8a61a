"""``python -m sparkloom``: ingests a folder into a vector store, once or until it is stopped."""

from __future__ import annotations

import sys

from .config import USAGE, configure_logging, parse_args
from .errors import LoomError

VERSION = "0.1.0"


def main(args: list[str]) -> int:
    try:
        log = configure_logging()
        config = parse_args(args)
        if isinstance(config, str):
            print(USAGE if config == "help" else f"sparkloom {VERSION}")
            return 0
        for warning in config.warnings:
            log.warning(warning)
        from pyspark.sql import SparkSession

        from .streaming.ingest import IngestConfig, IngestSummary, start

        spark = SparkSession.builder.appName("sparkloom").getOrCreate()
        log.info({"event": "start", "root": config.root, "collection": config.store.collection})
        ingest = IngestConfig(config.root, config.checkpoint, config.chunker, ack_path=config.ack_path, ack_failed=config.ack_failed, max_files=config.max_files, signals=config.signals, retries=config.retries)
        query = start(spark, ingest, config.store, config.provider, IngestSummary(log.info), config.once, log=log)
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
        return 0
    except LoomError as e:
        print(f"fatal: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
