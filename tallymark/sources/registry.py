"""Sources by agent id, and the union of what several of them read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from . import antigravity, codex, copilot, databases, documents, jsonl, sessions, stores

SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "claude": jsonl.claude, "codex": codex.codex, "qwen": jsonl.qwen, "kimi": jsonl.kimi, "grok": jsonl.grok, "commandcode": jsonl.commandcode,
    "continue": databases.continue_either, "gemini": documents.gemini, "amp": documents.amp, "cline": documents.cline, "goose": databases.goose,
    "hermes": databases.hermes, "kilo": databases.kilo, "zcode": databases.zcode, "continue-db": databases.continue_db,
    "openclaw": sessions.openclaw, "droid": sessions.droid, "copilot": copilot.copilot, "pi": sessions.pi, "cyberine": sessions.cyberine, "codebuff": sessions.codebuff,
    "antigravity": antigravity.antigravity, "opencode": stores.opencode, "muse": stores.muse,
}


#: Sources that leave files unopened that were last written before the day of a report.
PRUNED = {"claude", "codex"}


def read_usage(spark: SparkSession, roots: dict[str, str], since: str | None = None) -> DataFrame:
    """Usage of several agents: {agent id: folder}. The rows of all sources are kept.

    `since` (a day) spares files that can't hold rows from that day on, where a source can tell; it filters no rows.
    """
    unknown = set(roots) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    read = lambda a, root: SOURCES[a](spark, root, since=since) if since and a in PRUNED else SOURCES[a](spark, root)
    return reduce(DataFrame.unionByName, [read(a, root) for a, root in roots.items()])
