"""``python -m skein build <target> [output] [--import]`` and ``python -m skein serve <root>``."""

from __future__ import annotations

import sys

USAGE = """usage: python -m skein <command>

  build <target> [output=./output] [--import] [--keep-edges]
      scan a source tree (TypeScript, TSX, Python, Go, PHP, Bash) and export its graph
  serve <root>
      answer graph queries over standard input and output
"""


def main(argv: list[str]) -> int:
    flags = {a for a in argv if a.startswith("--")}
    words = [a for a in argv if not a.startswith("-")]
    if "--help" in flags or "-h" in argv:
        print(USAGE)
        return 0
    if not words or words[0] not in ("build", "serve") or len(words) < 2:
        print(USAGE, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("skein").getOrCreate()
    if words[0] == "serve":
        from skein.serve import serve

        serve(spark, words[1])
        return 0
    from skein.build import build

    try:
        r = build(spark, words[1], words[2] if len(words) > 2 else "./output", "--import" in flags, "--keep-edges" in flags)
    except (FileNotFoundError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if not r.written:
        print("No supported files found.", file=sys.stderr)
    else:
        print(f"{r.files} files, {r.nodes} nodes, {r.edges} edges, {r.preserved} semantic records kept")
        if not r.nodes:
            print("Warning: no nodes extracted.", file=sys.stderr)
    return 0


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
