"""Secret scanning: a wide pattern finds candidates, a random forest removes the false ones.

The forest sees a candidate's length, its character classes and transitions, how much of it
dictionary words (of its document and of the whole corpus) cover, its path-likeness and its
document's path, and the words around it, hashed, so that it has to learn which of them tell. It
is trained on labelled findings: given ones, or by default candidates of the same corpus that a
documented format or plain context labels. The rules that label are no features of the forest:
it judges findings that fit no rule by their likeness to those that do.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table

# Documented credential formats and words that announce secrets or harmless values.
FORMATS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|sk-[A-Za-z0-9_-]{20,}"
)
SECRET_WORDS = frozenset("password passwd passphrase pwd pass token secret apikey key credential credentials auth authorization bearer private accesskey secretkey access signature salt".split())
HARMLESS_WORDS = frozenset("sha sha1 sha256 md5 hash digest checksum commit revision uuid guid id isbn phone tel fax version build card visa order invoice etag".split())
DUMMY_WORDS = frozenset("example sample dummy changeme placeholder your test foo bar xxxx none null undefined redacted".split())

# A key block ends at its END line; no second BEGIN lies in it, so blocks without END cost no more than their length.
# A value after = or : (group) ends before the next name= and without closing brackets and full stops.
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?<=[=:])[ \t]*[\"'](?P<quoted>[^\s\"'<>]{4,})"
    r"|(?<=[=:])[ \t]*(?P<value>(?:(?!&[\w.%-]*=)[^\s\"'<>=:,;]){3,}(?!&[\w.%-]*=)[^\s\"'<>=:,;)\]}.`]={0,2})"
    r"|[A-Za-z0-9_+/.~-]{10,}={0,2}"
)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_LETTERS, _WORDS, _HEX = re.compile(r"[^\W\d_]{3,}"), re.compile(r"[^\W_]+"), re.compile(r"[0-9a-fA-F]+")
_MAIL = re.compile(r"[\w.+-]@(?:[\w-]+\.)+[A-Za-z]{2}|[\w.+-]@localhost\b")
_PIECES = re.compile(r"[\s<>\[\](){}._-]+")
_SAMPLE_PATH = re.compile(r"test|example|sample|fixture|mock|docs?\b", re.I)
FEATURES = ("length", "digits", "upper", "lower", "other", "transitions", "turns", "entropy", "hex", "numeric", "coverage", "separators", "sample_path", "secret_word", "harmless_word", "dummy", "assigned", "quoted", "address", "uuid", "format")


#: The features that the forest sees; the others only serve ``weak_label``.
SEEN = [i for i, f in enumerate(FEATURES) if f not in ("secret_word", "harmless_word", "dummy", "assigned", "address", "uuid", "format")]
#: Slots for words in front and behind and for parts of the path.
BEFORE_SLOTS, AFTER_SLOTS, PATH_SLOTS = 32, 16, 8


def _slots(words: list[str], slots: int) -> list[float]:
    out = [0.0] * slots
    for w in words:
        out[zlib.crc32(w.encode()) % slots] = 1.0
    return out


def surroundings(text: str, start: int, end: int, path: str) -> list[float]:
    """Shares of the 16 transitions between character classes, hashed words around, hashed path."""
    kinds = [_kind(c) for c in text[start:end]]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    near = [w.lower() for w in _WORDS.findall(text[max(0, start - 40) : start])][-3:]
    after = [w.lower() for w in _WORDS.findall(text[end : end + 30])][:2]
    moves = [pairs[a, b] / max(1, len(kinds) - 1) for a in range(4) for b in range(4)]
    return moves + _slots(near, BEFORE_SLOTS) + _slots(after, AFTER_SLOTS) + _slots(_WORDS.findall(path.lower()), PATH_SLOTS)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(text: str, start: int, end: int, vocabulary: frozenset | set, path: str) -> list[float]:
    """The features of one candidate, in the order of ``FEATURES``."""
    raw = text[start:end]
    n, kinds = len(raw), [_kind(c) for c in raw]
    share = [kinds.count(k) / n for k in range(4)]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    turns = sum(v for (a, b), v in pairs.items() if a != b)
    counts = Counter(raw)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    transition = -sum(v / max(1, n - 1) * math.log2(v / max(1, n - 1)) for v in pairs.values())
    words = _LETTERS.findall(raw)
    covered = sum(len(w) for w in words if w.lower() in vocabulary)
    before = text[max(0, start - 40) : start]
    near = [w.lower() for w in _WORDS.findall(before)][-3:]
    after = [w.lower() for w in _WORDS.findall(text[end : end + 30])][:2]
    around = {*near, *after, *(f"{a}{b}" for a, b in zip(near, near[1:], strict=False))}
    lead = before.rstrip(" \t\"'")
    # Long key blocks hold short words by chance; there only whole pieces count.
    dummy = bool(DUMMY_WORDS & set(_PIECES.split(raw.lower()))) if raw.startswith("-----BEGIN") else any(w in raw.lower() for w in DUMMY_WORDS)
    return [
        float(min(n, 200)), *share, transition, turns / max(1, n - 1), entropy, float(bool(_HEX.fullmatch(raw))), float(share[0] == 1), covered / n, sum(map(raw.count, "/.-_")) / n,
        float(bool(_SAMPLE_PATH.search(path))), float(bool(around & SECRET_WORDS)), float(bool(around & HARMLESS_WORDS)), float(dummy or max(counts.values()) > 0.6 * n),
        float(lead[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")), float("@" in (before[-1:], text[end : end + 1]) or bool(_MAIL.search(raw)) or before.endswith("://")), float(bool(_UUID.fullmatch(raw))), float(bool(FORMATS.fullmatch(raw)) or raw.startswith("-----BEGIN")),
    ]


def weak_label(x: list[float]) -> float:
    """1 for a finding that its format or context shows to be a secret, 0 for any other."""
    f = dict(zip(FEATURES, x, strict=True))
    if f["dummy"] or f["uuid"] or f["address"]:
        return 0.0
    if f["format"]:
        return 1.0
    return float(f["secret_word"] and f["assigned"] and not f["harmless_word"] and f["coverage"] < 0.5 and f["entropy"] > 2.5)


def _dictionary(text: str, raw: str, places: dict[str, list[int]]) -> set[str]:
    """The words of ``raw`` that its text also holds outside all places of ``raw`` itself."""
    low, offsets = raw.lower(), {}
    for m in _LETTERS.finditer(raw):
        offsets.setdefault(m[0].lower(), []).append(m.start())
    own = lambda w, at: any(at >= o and text[at - o : at - o + len(raw)].lower() == low for o in offsets[w])
    return {w for w in offsets if w in DUMMY_WORDS or not all(own(w, at) for at in places.get(w, ()))}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, text_key, start, end (code points), x (features), weak, more, runs.

    ``more`` are its ``surroundings`` and ``runs`` its runs of letters in lower case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], [], []]
            for doc, key, text, path in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_key", "text", "path")), strict=True):
                places, known = None, {}
                for m in CANDIDATE.finditer(text):
                    start, end = m.span(m.lastgroup or 0)
                    raw = text[start:end]
                    if not m.lastgroup and not any(map(str.isdigit, raw)) and not raw.startswith("-----BEGIN") and text[start - 1 : start] not in ("=", ":", "\"", "'"):
                        continue
                    if places is None:
                        places = {}
                        for w in _LETTERS.finditer(text):
                            places.setdefault(w[0].lower(), []).append(w.start())
                    if raw not in known:
                        known[raw] = _dictionary(text, raw, places)
                    x = describe(text, start, end, known[raw], path or "")
                    for column, value in zip(rows, (doc, key, start, end, x, weak_label(x), surroundings(text, start, end, path or ""), [w.lower() for w in _LETTERS.findall(raw)]), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "text_key", "start", "end", "x", "weak", "more", "runs"])

    return _keyed(docs, id_col, text_col, path_col).mapInArrow(run, "doc_id long, text_key long, start long, end long, x array<double>, weak double, more array<double>, runs array<string>")


def _keyed(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), path.alias("path"))


def _known(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """Distinct runs of letters of the candidates that at least two different texts hold: (run)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    said = docs.select(F.xxhash64(text).alias("key"), F.explode(words).alias("run"))
    wanted = found.select(F.explode("runs").alias("run")).distinct()
    return said.groupBy("run").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").join(wanted, "run", "left_semi").select("run")


def judged_by(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """``found`` with ``v``: what the forest sees, the share of known runs of letters included."""
    keys = ["doc_id", "text_key", "start", "end"]
    runs = found.select("text_key", "start", "end", F.explode("runs").alias("run")).distinct()
    known = runs.join(_known(docs, found, text_col), "run").groupBy("text_key", "start", "end").agg(F.sum(F.length("run")).cast("double").alias("known"))
    share = F.coalesce("known", F.lit(0.0)) / F.greatest(F.col("end") - F.col("start"), F.lit(1))
    seen = F.array(*[F.col("x")[i] for i in SEEN], share)
    return found.join(known, keys[1:], "left").select(*keys, "x", "weak", F.concat(seen, "more").alias("seen"))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", sample_findings: int = 20_000, trees: int = 30, depth: int = 8) -> DataFrame:
    """One row per (doc_id, text_key) with candidates: n_candidates and spans of its secrets.

    ``labelled``: findings (doc_id, start, end, is_secret) to train on, taken as they are;
    otherwise candidates label themselves by ``weak_label``. The forest is trained on about
    ``sample_findings`` findings, both labels with equal weight in sum; every candidate of every
    whole text is then judged by it. If all findings have the same label, every candidate gets
    that label. Candidates don't overlap: of several that begin at one place the pattern's first
    alternative counts.
    """
    found = settle(candidates(docs, id_col, text_col, path_col), "secrets-candidates")
    found = settle(judged_by(docs, found, text_col), "secrets-seen")
    if labelled is not None:
        given = labelled.select(F.col("doc_id"), F.col("start"), F.col("end"), F.col("is_secret").cast("double").alias("label"))
        examples = found.join(given, ["doc_id", "start", "end"]).select("doc_id", "start", "seen", "label")
    else:
        examples = found.select("doc_id", "start", "seen", F.col("weak").alias("label"))
    n = examples.count()
    share = min(1.0, sample_findings / max(1, n))
    picked = settle(examples.where(F.pmod(F.xxhash64("doc_id", "start"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))).select(array_to_vector("seen").alias("v"), "label"), "secrets-examples")
    seen = {r[0]: r[1] for r in picked.groupBy("label").count().collect()}
    if len(seen) == 2:
        weight = F.when(F.col("label") == 1.0, sum(seen.values()) / (2 * seen[1.0])).otherwise(sum(seen.values()) / (2 * seen[0.0]))
        forest = RandomForestClassifier(featuresCol="v", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=5)
        model = forest.fit(picked.withColumn("weight", weight))
        judged = model.transform(found.withColumn("v", array_to_vector("seen"))).withColumn("secret", vector_to_array("probability")[1] >= 0.5)
    else:
        judged = found.withColumn("secret", F.lit(set(seen) == {1.0}))
    span = F.when(F.col("secret"), F.struct("start", "end"))
    return judged.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_candidates"), F.array_sort(F.collect_set(span)).alias("spans"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per input row: doc_id, n_candidates, n_secrets, spans of (start, end).

    Positions count code points of the whole text. Null and empty texts have none, a null path
    is empty, a null ``doc_id`` stays null; repeated rows give repeated results and count their
    candidates together; an empty table gives no rows; other columns are ignored.
    """
    found = find_secrets(docs, labelled, id_col, text_col, path_col)
    found = found.withColumnRenamed("doc_id", "of").withColumnRenamed("text_key", "key")
    rows = _keyed(docs, id_col, text_col, path_col).select("doc_id", "text_key")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return joined.select("doc_id", F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"), F.size(spans).cast("long").alias("n_secrets"), spans.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; all else stays."""
    found = find_secrets(docs, None, id_col, text_col, path_col).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("__of"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    text = F.col(f"`{text_col}`")
    key = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    joined = docs.join(found, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__of")) & (key == F.col("__key")), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end"]))
    starts = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    clean = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(text, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))), mark)
    return joined.select(*[F.when(F.col("__spans").isNotNull(), clean).otherwise(text).alias(c) if c == text_col else docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_candidates", "n_secrets", F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"))
