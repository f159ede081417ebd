"""Removal of personal data by pattern, and of terms that disclose it.

The base finds e-mail addresses, IP addresses, card and phone numbers.  Each
value found is a protected entity.  How much a term reveals of an entity e
is estimated from the corpus:

    disclosure(t, e) = PMI(t, e) / IC(e),
    PMI = log(N * df(t, e) / (df(t) * df(e))),  IC(e) = log(N / df(e))

where df counts documents, and df(t, e) those that hold both, wherever in the text.
It is 1 if t occurs with e only, and 0 if they are independent.  The evidence is
the number c of different contexts (the words within ``WINDOW`` words of e; copies
of one passage are one context).  From ``SUPPORT`` contexts on the estimate stands as
it is; with fewer, df(t, e) is discounted by c / (c + 1), the factor of Pantel and Lin.
So one context is enough where e is rare in a large corpus (N >= 1024 df(e) at
``GENERALISE``, if t occurs with e only), and two from N >= 58 df(e).  In documents that
hold e, a term at or above ``GENERALISE`` is replaced by its category and one at or
above ``REMOVE`` is taken out.

Scale: a document with entities emits a row per entity and one per different term.
Entities of one text only, nearly all, count alike and are one class per text.
A term can disclose an entity only if it is rare enough for it: terms too common for
all entities of their text drop out, first by their documents among those emitted and
then by the counts of all documents, before classes and terms of a text are paired.
Up to ``MOST_BROADCAST`` terms are broadcast for these counts; beyond, the counts of
all terms are aggregated first and joined.

Defined cases: a null text is the empty text and has no spans; repeated rows are
counted as documents each, and get equal spans; very long texts are scanned
whole in linear time; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, key_and_text, lean, rewritten, slices

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 8
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.98
#: Terms whose counts are found by a broadcast (30 MB at most).
MOST_BROADCAST = 500_000
#: Rows of a batch that is handed on before the input batch ends.
BATCH_ROWS = 100_000

#: Base patterns (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
#: What follows an address's @, and numbers joined by single dots; neither ever goes back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'.,;:!?()[]{}<>*#$%&|-"
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL, found from each @: in linear time, where the pattern alone tries every
    character of a long run as the start of an address."""
    out: list[tuple[int, int]] = []
    for run in _MAIL_RUN.finditer(text):
        low = run.start()  # where an address's local part may begin
        at = text.find("@", low, run.end())
        while at >= 0:
            m = _DOMAIN.match(text, at + 1) if at > low else None
            if m:
                out.append((low, m.end()))
            low = m.end() if m else at + 1
            at = text.find("@", low, run.end())
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """The matches of IP with parts of at most 255: four by four of numbers joined by dots."""
    out: list[tuple[int, int]] = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            some = parts[k:k + 4]
            end = at + sum(map(len, some)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in some):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base, by kind, in linear time."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(a, b, "ip") for a, b in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return out


def term_of(word: str) -> str:
    return word.strip(_TRIM).lower()


def entity_of(value: str, kind: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def holdings(text: str, spans: list[Span], window: int = WINDOW) -> tuple[dict[str, int], set[str]]:
    """entity -> context number (of the terms within ``window`` words; the least, of several), and
    the terms of the whole text outside the spans."""
    covered: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(end, covered[-1][1])
        else:
            covered.append([start, end])
    starts, terms, at = [], [], 0
    for m in _WORD.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        starts.append(m.start())
        terms.append("" if at < len(covered) and covered[at][0] < m.end() else term_of(m[0]))
    held: dict[str, int] = {}
    for start, end, kind in spans:
        entity = entity_of(text[start:end], kind)
        a = max(0, bisect_left(starts, start + 1) - 1)
        b = bisect_left(starts, end)
        near = " ".join(t for t in terms[max(0, a - window):b + window] if t)
        seen = int.from_bytes(hashlib.blake2b(near.encode(), digest_size=8).digest(), "little", signed=True)
        held[entity] = min(seen, held.get(entity, seen))
    return held, set(terms) - {""}


def contexts(text: str, spans: list[Span], window: int = WINDOW) -> dict[tuple[str, str], int]:
    """(entity, term) -> context number, for all terms of the text."""
    held, terms = holdings(text, spans, window)
    return {(entity, term): seen for entity, seen in held.items() for term in terms}


def term_spans(text: str, terms: set[str], covered: list[Span]) -> list[Span]:
    """Occurrences of disclosing terms, outside the base spans."""
    covered, at, out = sorted(covered), 0, []
    for m in _WORD.finditer(text):
        if (t := term_of(m[0])) in terms:
            start = m.start() + len(m[0]) - len(m[0].lstrip(_TRIM))
            end = start + len(t) if len(t) == len(m[0].strip(_TRIM)) else m.end()
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            if not any(s < end for s, _, _ in covered[at:at + 1]):
                out.append((start, end, "term"))
    return out


def sanitised(text: str, spans: list[Span], removed: set[str]) -> str:
    """The text with spans replaced by their kind, and disclosing terms generalised or removed."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end <= at:
            continue
        out.append(text[at:max(at, start)])
        if start >= at:
            word = text[start:end]
            if kind != "term":
                out.append(f"<{kind.upper()}>")
            elif term_of(word) not in removed:
                out.append("<NUMBER>" if word.isdigit() else "<NAME>" if word[:1].isupper() else "<WORD>")
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _context_rows(window: int):
    """Per text with entities: a row for each entity (without term) and for each term (without entity)."""
    names = ["digest", "entity", "term", "seen"]
    kinds = [pa.binary(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in slices(batches):
            rows: list[tuple] = []
            for text in b.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    digest = hashlib.sha256(text.encode()).digest()
                    held, terms = holdings(text, spans, window)
                    rows += [(digest, entity, "", seen) for entity, seen in held.items()]
                    rows += [(digest, "", term, 0) for term in terms]
                if len(rows) > BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _telling(rows: DataFrame, near: DataFrame, support: int, least: float, most_broadcast: int, settled: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class, term, disclosure) at or above ``least``; (entity, class); (class, digest) of the texts that hold it."""
    spark = rows.sparkSession
    n = float(rows.count())
    weight = lambda c: F.when(c >= settled, 1.0).otherwise(c / (c + 1.0))
    held = near.where("entity != ''").groupBy("digest", "entity", "seen").agg(F.count("*").alias("copies"))
    # Entities of one text have one context, and the same figures with each term: one class.
    of_entity = rewritten(held.groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.min("digest").alias("digest"), F.max("digest").alias("last"), F.countDistinct("seen").alias("contexts"))
                          .where((F.col("df_entity") < n) & (F.col("contexts") >= support))
                          .withColumn("class", F.when(F.col("digest") == F.col("last"), F.hex("digest")).otherwise(F.col("entity"))), "entities")
    single = of_entity.where("digest = last").select("class", "digest", F.lit(0).cast("long").alias("seen"), F.col("df_entity").alias("copies"), "df_entity", "contexts").distinct()
    several = broadcast_if_small(rewritten(of_entity.where("digest != last").select("class", "entity", "df_entity", "contexts"), "several"), most_broadcast)
    several = held.join(several, "entity").select("class", "digest", "seen", "copies", "df_entity", "contexts")
    # disclosure >= least means df(t) <= df(t, e) weight (N / df(e))^(1 - least), where df(t, e) <= df(e) and df(t, e) <= df(t).
    gain = weight(F.col("contexts")) * F.pow(F.lit(n) / F.col("df_entity"), 1 - least) * (1 + 1e-9)
    classes = rewritten(single.unionByName(several).withColumn("most", gain * F.col("df_entity")).where(F.col("most") >= F.col("df_entity")), "classes")
    members = of_entity.select("entity", "class")
    none = spark.createDataFrame([], "class string, term string, disclosure double")
    most = classes.agg(F.max("most")).first()[0]
    if most is None:
        return none, members, classes

    # The documents among those emitted are a part of df(t): common words drop out before the corpus is counted.
    words = near.where("term != ''")
    rare = broadcast_if_small(rewritten(words.groupBy("term").agg(F.count("*").alias("seen_in")).where(F.col("seen_in") <= most), "rare"), most_broadcast)
    of_text = classes.groupBy("digest").agg(F.max("most").alias("most_here"))
    inside = rewritten(words.join(rare, "term").groupBy("digest", "term").agg(F.first("seen_in").alias("seen_in")).join(of_text, "digest")
                       .where(F.col("seen_in") <= F.col("most_here")).select("digest", "term", "most_here"), "inside")
    terms = rewritten(inside.select("term").distinct(), "terms")
    few = terms.count()
    if not few:
        return none, members, classes
    # The word's trim and lower case, as term_of has them.
    trim = F.array_distinct(F.transform(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.lower(F.btrim(w, F.lit(_TRIM)))))
    words = rows.select(F.explode(trim).alias("term"))
    if few <= most_broadcast:
        counts = words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df_term"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("df_term")).join(terms, "term")
    counts = rewritten(counts.where(F.col("df_term") <= most), "counts")
    inside = inside.join(broadcast_if_small(counts, most_broadcast), "term").where(F.col("df_term") <= F.col("most_here"))
    pairs = (inside.join(classes.drop("contexts"), "digest").where(F.col("df_term") <= F.col("most")).groupBy("class", "term")
             .agg(F.sum("copies").alias("joint"), F.countDistinct("seen").alias("contexts"), F.first("df_entity").alias("df_entity"), F.first("df_term").alias("df_term"))
             .where(F.col("contexts") >= support))
    pmi = F.log(F.lit(n) * F.col("joint") * weight(F.col("contexts")) / (F.greatest("df_term", "joint") * F.col("df_entity")))
    share = pmi / F.log(F.lit(n) / F.col("df_entity"))
    return pairs.select("class", "term", share.alias("disclosure")).where(F.col("disclosure") >= least), members, classes


def disclosing_terms(rows: DataFrame, near: DataFrame, support: int = 1, least: float = GENERALISE,
                     most_broadcast: int = MOST_BROADCAST, settled: int = 1) -> DataFrame:
    """(entity, term, disclosure) at or above ``least``, of pairs with ``support`` contexts; those with
    fewer than ``settled`` are discounted.  ``near`` has the rows of ``_context_rows``."""
    telling, members, _ = _telling(rows, near, support, least, most_broadcast, settled)
    return telling.join(members, "class").select("entity", "term", "disclosure")


def _apply(batches):
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "sanitised"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 3
    for b in slices(batches):
        rows = []
        for key, text, terms, removed in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            base = base_spans(text)
            more = term_spans(text, set(terms), base) if terms else []
            n = [sum(s[2] == k for s in base) for k in KINDS[:4]]
            out = sanitised(text, base + more, set(removed or ())) if base or more else text
            rows.append((key, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), out))
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def found_and_sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, support: int = SUPPORT,
                        generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised."""
    rows = key_and_text(docs, key, text)
    revealed = revealed_terms(rows, window, support, generalise, remove)
    ready = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).join(revealed, "digest", "left").select("doc_id", "text", "terms", "removed")
    return ready.mapInArrow(lean(_apply), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, sanitised string")


def revealed_terms(rows: DataFrame, window: int, support: int, generalise: float, remove: float) -> DataFrame:
    """(digest of the text, terms to replace in it, those of them to remove) as a written table."""
    near = rewritten(rows.select("text").mapInArrow(lean(_context_rows(window)), "digest binary, entity string, term string, seen long"), "contexts")
    telling, _, classes = _telling(rows, near, 1, generalise, MOST_BROADCAST, support)
    each = classes.select("class", "digest").join(telling, "class")
    return rewritten(each.groupBy("digest", "term").agg(F.max("disclosure").alias("d")).groupBy("digest").agg(
        F.collect_list("term").alias("terms"), F.collect_list(F.when(F.col("d") >= remove, F.col("term"))).alias("removed")), "revealed")


def _rewrite(batches):
    for b in slices(batches):
        out = []
        for text, terms, removed in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True):
            spans = base_spans(text) if text else []
            if text and terms:
                spans += term_spans(text, set(terms), spans)
            out.append(sanitised(text, spans, set(removed or ())) if spans else text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "clean"])


def sanitised_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", window: int = WINDOW, support: int = SUPPORT,
                        generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """All documents with their columns, the text sanitised and ``n_chars`` (if there) following."""
    body = docs.select(F.struct("*").alias("row"), docs[text].cast("string").alias("text"))
    revealed = revealed_terms(body.select("text"), window, support, generalise, remove)
    ready = body.withColumn("digest", F.unhex(F.sha2("text", 256))).join(revealed, "digest", "left").select("row", "text", "terms", "removed")
    out = ready.mapInArrow(lean(_rewrite), T.StructType([T.StructField("row", body.schema["row"].dataType), T.StructField("clean", T.StringType())]))
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == n_chars:
            value = F.when(F.col(f"row.`{text}`").eqNullSafe(F.col("clean")), value).otherwise(F.length("clean").cast(docs.schema[name].dataType))
        columns.append((F.col("clean") if name == text else value).alias(name))
    return out.select(*columns)
