"""Line dedup, filter audit and Merkle manifest on odd rows, against brute force; and on empty tables."""

import collections
import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import audit, common, lines, merkle
from seriesloom.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
LINE = "The same footer stands under every page"
#: (doc_id, text, lang, source, n_chars)
ROWS = [
    (1, f"{LINE}\nfirst\n{LINE}", "en", "web", 5),
    (2, f"own line of two\n  {LINE.upper()}\t\nshort\nshort\n{LINE}", "en", None, None),
    (3, None, None, "web", 0),
    (4, "", "", "", 0),
    (5, "\n\n", "de", "web", 2),
    (6, "ééééééééé\nçççççççççç\n漢字漢字漢字漢字漢字", "de", "web", 9),  # nine and ten code points
    (7, "ÇÇÇÇÇÇÇÇÇÇ\nçççççççççç\r\n漢字漢字漢字漢字漢字\x0b\n\x00nul byte line", "de", "web", 9),  # only A-Z are lower-cased
    (None, f"{LINE}\nnobody's line it is", "en", "web", 9),
    (None, "nobody's line it is\nMORE CAPITALS THAN ALLOWED", "en", "web", 9),
    (8, "word " * 30_000 + "\n" + LINE, "en", "web", 9),  # very long
    (9, "a b c d e f g h i j " * 12, "fr", "web", 9),
    (10, "a b c d e f g h i j " * 12, "fr", "web", 9),
    (10, "a b c d e f g h i j " * 12, "fr", "web", 9),  # a repeated row
    (10, "another text of the same id", "fr", "books", 9),
    (11, " ".join(f"w{i}" for i in range(130)), "en", "a:b", 7),
    (12, " ".join(f"w{i}" for i in range(130)), "es", "a:b", 7),
    (13, " ".join(f"w{i}" for i in range(130)) + " 100%", "es", "a:b", 7),
    (14, "X" * 12, "it", "web", 12),  # the only one of its part
]
LABELS = [(1, 1, 0), (2, 1, 1), (9, 0, 1), (9, None, None), (10, 1, 0), (12, 1, 1), (None, 1, 1), (99, 1, 1), (13, None, 1)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, n long, tree string, place long, level int, part string, mask int, node string, good int, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", 2, "t", 3, 4, "p", 5, "n", 6, "d") for r in ROWS], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def plain_lines(rows, min_chars):
    """The rule, row by row."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    place = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(place(i))
    out = []
    for i, t, *_ in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < min_chars or len(holders[key(x)]) < 2 or min(holders[key(x)]) == place(i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("min_chars,max_bits", [(10, lines.MAX_BITS), (3, lines.MAX_BITS), (10, 8 * lines.PIECE)])
def test_lines(spark, docs, monkeypatch, min_chars, max_bits):
    monkeypatch.setattr(lines, "MIN_BITS", 256 if max_bits < lines.MAX_BITS else lines.MIN_BITS)  # a filter so full that it suspects nearly all
    got = lines.drop_repeated_lines(docs, min_chars, max_bits if max_bits == lines.MAX_BITS else 256)
    assert collections.Counter(map(tuple, got.collect())) == plain_lines(ROWS, min_chars)


def test_filters_miss_nothing(spark):
    """Lines held by two rows are suspected whichever tasks hold them; most others are not."""
    own = [f"line number {i} of its document" for i in range(4000)]
    again = [f"line number {i} that comes again" for i in range(300)]
    rows = [(i, "\n".join(own[20 * i : 20 * i + 20] + again[i : i + 40])) for i in range(200)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(7)
    bits = lines.filter_bits(4000 + 200 * 40)
    twice = lines.Filter(bits, lines.seen_again(texts, bits, 10))
    assert twice.has(lines._hashes(k.encode() for k in again[1:238])).all()
    assert twice.has(lines._hashes(k.encode() for k in own)).mean() < 0.1


def test_join_counted(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 500 + ["b"] * 3 + ["c"])], "key string, i long")
    table = rows.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'c'")
    got = common.join_counted(rows, table, "key", "n", 2)
    assert sorted((r["key"], r["i"], r["n"]) for r in got.collect()) == [("a", i, 500) for i in range(500)] + [("b", i, 3) for i in range(500, 503)]


def plain_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    failing = []
    for i, t, lang, *_ in rows:
        text = t or ""
        ws = re.findall("[^\x20\x09-\x0d]+", text)
        fails = ""
        fails += "A" * (len(ws) < 100)
        fails += "B" * (100 * len(set(ws)) < 80 * len(ws))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * any(j is not None and i is not None and j < i and (u or "") == text for j, u, *_ in rows)
        failing.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {p for p, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[f] += len(gone)
        for order, step in ((o, s) for p, o, s in out if p == part):
            out[part, order, step].append(shapley[order[step - 1]])
    return out


def test_audit(spark, docs, labels, monkeypatch):
    want = plain_audit(ROWS, LABELS)
    for held in (audit.PARTS_HELD, 1):
        monkeypatch.setattr(audit, "PARTS_HELD", held)
        got = audit.filter_interactions(docs, labels).collect()
        assert len(got) == len(want)
        assert {(r["part"], r["filter_order"], r["step"]): [r[m] for m in audit.MEASURES] for r in got} == want


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, arity):
    """The root, and for each leaf what stands left and right of it, level by level."""
    level, of, paths = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        runs = [level[a : a + arity] for a in range(0, len(level), arity)]
        for leaf, place in enumerate(of):
            run, at = runs[place // arity], place % arity
            paths[leaf].append(("".join(run[:at]), "".join(run[at + 1 :])))
        of = [p // arity for p in of]
        level = [h(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows, arity):
    leaf = lambda i, t, lang, source, n: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append(((r[0] is not None, r[0] or 0), leaf(*r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: plain_tree([node for _, node, _ in sorted(trees[x])], arity) for x in langs}
    root, higher = plain_tree([made[x][0] for x in langs], arity)
    out = []
    for x, rest in zip(langs, higher, strict=True):
        for (_, node, r), path in zip(sorted(trees[x]), made[x][1], strict=True):
            acc = leaf(*r[:4], None if r[4] is None else r[4] + 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else node
            for a, b in path + rest:
                acc = h(a, acc, b)
            out.append((r[0], node, made[x][0], root, h(*(a + b for a, b in path + rest)), acc, acc == root))
    return collections.Counter(out)


@pytest.mark.parametrize("arity,tier", [(2, 6), (2, 1), (3, 2), (5, 1)])
def test_manifest(spark, docs, arity, tier):
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    got = merkle.manifest(docs, struck, {"n_chars": F.col("n_chars") + 1}, arity, tier).drop("path")
    assert collections.Counter(map(tuple, got.collect())) == plain_manifest(ROWS, arity)


def test_manifest_of_larger_trees(spark):
    """Trees of sizes around powers of two, over many partitions; a tampered row is the only one that fails."""
    rows = [(i, f"text {i}", lang, None, i) for lang, n in (("a", 1), ("b", 64), ("c", 65), ("d", 300)) for i in range(n)]
    docs = spark.createDataFrame([(*r,) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle.manifest(docs, (F.col("lang") == "c") & (F.col("doc_id") == 63), {"text": F.lit("another text")})
    assert [(r["doc_id"], r["verified"]) for r in got.where("NOT verified").collect()] == [(63, False)]
    want = plain_manifest([(*r[:4], r[4]) for r in rows], 2)
    assert {x[:5] for x in want} == {tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256").collect()}


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    assert lines.drop_repeated_lines(none).count() == 0
    assert audit.filter_interactions(none, labels).count() == 0
    assert merkle.manifest(none).count() == 0
    assert audit.filter_interactions(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_queries(spark, tmp_path):
    """The registered queries read the tables as they are, odd rows included."""
    sf = f"file://{tmp_path}"
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(ROWS, names).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = collections.Counter(map(tuple, QUERIES["op11_line_dedup"](spark, sf).collect()))
    want = collections.Counter()
    for (i, n, dropped, text), times in plain_lines(ROWS, 10).items():
        want[i, n, dropped, h(text)] += times
    assert got == want
    audited = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in audit.MEASURES] for r in QUERIES["op12_filter_audit"](spark, sf).collect()}
    assert audited == plain_audit(ROWS, LABELS)
    assert collections.Counter(map(tuple, QUERIES["op13_merkle_manifest"](spark, sf).collect())) == plain_manifest(ROWS, 2)
