"""construct, query and setop from a shell: ``python -m strandwise.cli``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .operators import kmers as K
from .operators import membership, minimizers, setops
from .sources import sequences, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandwise")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("construct", help="sequences to a stored set")
    c.add_argument("-f", "--file", required=True, nargs="+")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-k", type=int, required=True)
    c.add_argument("-m", type=int)
    c.add_argument("--buckets", type=int)
    c.add_argument("--max-ram", help="size such as 2G from which the number of buckets follows")
    c.add_argument("--sanitize", action="store_true")
    c.add_argument("--ascii", action="store_true", help="write super-k-mers as text")
    q = sub.add_parser("query", help="which k-mers of sequences are in a set")
    q.add_argument("-i", "--index", required=True)
    q.add_argument("-f", "--file", nargs="+")
    q.add_argument("sequence", nargs="?")
    q.add_argument("-o", "--output")
    s = sub.add_parser("setop", help="relations and sizes of two sets")
    s.add_argument("-a", required=True)
    s.add_argument("-b", required=True)
    s.add_argument("--strict", action="store_true")
    s.add_argument("--sizes", action="store_true")
    for name in setops.RELATIONS:
        s.add_argument(f"--{name.replace('_', '-')}", metavar="PATH")
    return p


def validate(args: argparse.Namespace) -> None:
    """Rules between options; ValueError names the first that is broken."""
    if args.command == "construct":
        K.check_k(args.k, args.m)
        if args.buckets is not None and args.max_ram:
            raise ValueError("give --buckets or --max-ram, not both")
        if args.buckets is not None and args.buckets < 1:
            raise ValueError("--buckets must be positive")
        if args.max_ram and not hashing.parse_size(args.max_ram):
            raise ValueError(f"--max-ram: {args.max_ram!r} is no size")
        if args.ascii and args.m is None:
            raise ValueError("--ascii needs -m")
    elif args.command == "query":
        if bool(args.file) == bool(args.sequence):
            raise ValueError("give a file or a sequence")
    else:
        setops.Request({n: p for n in setops.RELATIONS if (p := getattr(args, n))}, args.sizes).validate((args.a, args.b))


def construct(spark: SparkSession, args) -> int:
    records = sequences.read_fasta(spark, args.file)
    if args.sanitize:
        records = sequences.sanitize(records)
    if args.ascii:
        found = minimizers.superkmers(records, args.k, args.m)
        head = spark.createDataFrame([(minimizers.dump_header(found, args.k, args.m), 0)], "value string, at int")
        rows = minimizers.ascii_dump(found, args.k, args.m).withColumn("at", F.lit(1))
        head.unionByName(rows).repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.text(args.output)
        return 0
    buckets = args.buckets or 0
    if args.max_ram:
        n = K.count_kmers(records, args.k).first()["n"]
        buckets = max(1, min(65536, -(-n * 16 // hashing.parse_size(args.max_ram))))
    return store.write_set(K.key_set(records, args.k), args.output, args.k, args.m, buckets)


def query(spark: SparkSession, args):
    keys, meta = store.read_set(spark, args.index)
    records = sequences.read_fasta(spark, args.file) if args.file else sequences.from_strings(spark, [args.sequence])
    out = membership.lines(membership.presence(records, keys, meta["k"], meta["n_kmers"]))
    if args.output:
        out.select("line").write.text(args.output)
    else:
        for r in out.orderBy("record_id").toLocalIterator():
            print(r["line"])


def setop(spark: SparkSession, args) -> dict[str, int]:
    (a, ma), (b, mb) = store.read_set(spark, args.a), store.read_set(spark, args.b)
    store.check_compatible(ma, mb, args.strict)
    request = setops.Request({n: p for n in setops.RELATIONS if (p := getattr(args, n))}, args.sizes)
    found = setops.multi(a, b, request, lambda df, path: store.write_set(df, path, ma["k"], ma["m"]), (args.a, args.b))
    if args.sizes:
        for name in setops.SIZES:
            print(f"{name}\t{found[name]}")
    for name in request.outputs:
        print(f"wrote {found[name]} k-mers: {name}", file=sys.stderr)
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        validate(args)
        spark = SparkSession.builder.appName("strandwise").getOrCreate()
        {"construct": construct, "query": query, "setop": setop}[args.command](spark, args)
    except ValueError as e:
        print(f"strandwise: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
