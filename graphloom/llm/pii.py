"""Personal data: base patterns by position, and terms that disclose protected entities by corpus statistics.

All of it is DataFrame functions. Base spans come from regular expressions whose loops run over single
character classes: dots and separators that a pattern may cross are first replaced, one for one, by
U+0001, so long runs neither backtrack nor recurse. Terms of documents with spans are judged by information: with N
documents, a term discloses an entity when PMI(term; entity) = log2(N co / (df(term) df(entity))) is at
least a given share of the entity's information content log2(N / df(entity)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, sieve, stage

KINDS = ("email", "ip", "card", "phone")
GENERALISE_AT, REMOVE_AT = 0.9, 0.98  # shares of the entity's information
TERM = r"\p{L}[\p{L}\p{N}]{3,}"  # lower-cased words of four or more

_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _spans(scan: str, pattern: str) -> str:
    """SQL: array of (start, end, m) of a pattern's matches in code points, from what splitting leaves between them."""
    # fmt: off
    return (
        f"aggregate(zip_with(split({scan}, {pattern}, -1), regexp_extract_all({scan}, {pattern}, 0),"
        " (p, m) -> named_struct('p', length(p), 'n', length(m), 'm', m)),"
        " named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,m:string>>)),"
        " (a, x) -> if(x.m is null, a, named_struct('at', a.at + x.p + x.n, 'out',"
        " concat(a.out, array(named_struct('start', a.at + x.p, 'end', a.at + x.p + x.n, 'm', x.m))))), a -> a.out)"
    )
    # fmt: on


def _lit(pattern: str) -> str:
    return "r'" + pattern + "'"


_SAFE = "translate(_t, '\\u0001', '\\u0002')"
_NONE = "cast(array() as array<struct<start:int,end:int,m:string>>)"


def _crossed(char_class: str, before: str, after: str) -> str:
    return f"regexp_replace({_SAFE}, {_lit(f'(?<={before}){char_class}(?={after})')}, '\\u0001')"


def _base() -> dict[str, str]:
    one = "\\x01"
    label, local = "[A-Za-z0-9-]", f"[A-Za-z0-9._%+{one}-]"
    # A match starts where a run of its first class starts, or where the last match ended inside such a run.
    email = _spans(_crossed("[.]", label, label), _lit(f"(?:\\G|(?<!{local})){local}++@{label}++{one}[A-Za-z0-9{one}-]++"))
    ip = _spans("_t", _lit("(?:\\G|(?<![0-9]))[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++"))
    run = f"[0-9{one}]"
    card = _spans(_crossed("[\\x20-]", "[0-9]", "[0-9]"), _lit(f"(?<!{run})(?:[0-9]{one}?){{12,18}}[0-9](?!{run})"))
    phone = _spans("_t", _lit("[+][0-9][\\x20().0-9-]+[0-9]"))
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    luhn = (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, 1, 2) * int(substring({digits}, -i, 1))"
        f" - if(i % 2 = 0 and int(substring({digits}, -i, 1)) > 4, 9, 0)) % 10 = 0"
    )
    return {
        "email": f"if(contains(_t, '@'), {email}, {_NONE})",
        "ip": f"if(_t rlike {_lit('[0-9][.][0-9]+[.][0-9]+[.][0-9]')}, filter({ip}, x -> x.m rlike {_lit(f'^{_IP_PART}(?:[.]{_IP_PART}){{3}}$')}), {_NONE})",
        "card": f"if(_t rlike {_lit('[0-9](?:[\\x20-]?[0-9]){12}')}, filter({card}, x -> {luhn}), {_NONE})",
        "phone": f"if(contains(_t, '+'), filter({phone}, x -> length({digits}) between 9 and 15), {_NONE})",
    }


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `_t` (the text, null as empty) and the base spans `_email`, `_ip`, `_card`, `_phone`."""
    out = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    return out.select("*", *[F.expr(sql).alias(f"_{kind}") for kind, sql in _base().items()])


def joined(*kinds: str) -> Column:
    """kind:start:end of all spans, by kind as given, then start."""
    return F.expr("concat_ws(',', " + ", ".join(f"transform(_{k}, x -> concat('{k}:', x.start, ':', x.end))" for k in kinds) + ")")


def _replaced(marks: str) -> str:
    """SQL: _t with the spans of an array (start, end, m), sorted by start, replaced by their m; overlapping ones once."""
    return (
        f"aggregate({marks}, named_struct('at', 0, 'out', ''), (a, x) -> if(x.start >= a.at,"
        " named_struct('at', x.end, 'out', concat(a.out, substring(_t, a.at + 1, x.start - a.at), x.m)),"
        " named_struct('at', greatest(a.at, x.end), 'out', a.out)), a -> concat(a.out, substring(_t, a.at + 1)))"
    )


def disclosing_terms(based: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, terms, removed): of each document with an id, the terms it holds that disclose an entity of any document.

    based: rows of with_base() that have a doc_id and at least one span. docs: the whole corpus, over
    which N and df(term) are counted, each term once a document. A term counts with an entity in every
    document that has both, wherever they stand; words inside base spans are no candidates.
    """
    normal = "concat('{k}:', {v})"
    value = {"email": "lower(replace(x.m, '\\u0001', '.'))", "ip": "x.m", "card": "regexp_replace(x.m, '[^0-9]', '')", "phone": "regexp_replace(x.m, '[^0-9]', '')"}
    each = ", ".join(f"transform(_{k}, x -> {normal.format(k=k, v=value[k])})" for k in KINDS)
    entity = stage(based.select("doc_id", F.explode(F.expr(f"array_distinct(concat({each}))")).alias("e")).distinct(), "entities")
    # Entities of the same documents disclose by the same terms: one of them (by two hashes of the documents) stands for all.
    same = entity.groupBy("e").agg(F.count("*").alias("df_e"), F.bit_xor(F.xxhash64("doc_id")).alias("g1"), F.bit_xor(F.xxhash64("doc_id", F.lit("g"))).alias("g2"))
    group = stage(entity.join(stage(same, "groups"), "e").select("doc_id", "df_e", "g1", "g2").distinct(), "members")
    blank = ", ".join(f"transform(_{k}, x -> named_struct('start', x.start, 'end', x.end, 'm', ' '))" for k in KINDS)
    held = based.select("doc_id", F.expr(_replaced(f"array_sort(concat({blank}))")).alias("_rest"))
    held = stage(held.select("doc_id", F.explode(F.expr(_words("_rest"))).alias("term")).distinct(), "held")
    words = docs.select(F.col("doc_id"), F.explode(F.expr(_words(text_col))).alias("term"))
    df_t = words.groupBy("term").agg(F.count("*").alias("df_t"))
    df_t = stage(df_t.join(held.select("term").distinct(), "term", "left_semi"), "df")
    n = docs.count()
    # co is at most df(term) and df(entity). The first bound drops terms that fail with the document's most
    # frequent entity, before terms and entities of a document meet.
    info = f"log2({n}D / df_e)"
    told_by = lambda co: F.expr(f"if({info} > 0, log2({n}D * {co} / (df_t * df_e)) / {info}, 0D)")
    top = group.groupBy("doc_id").agg(F.max("df_e").alias("df_e"))
    rare = held.join(df_t, "term").join(top, "doc_id").filter(told_by("least(df_t, df_e)") >= GENERALISE_AT - 1e-9).drop("df_e")
    pairs = rare.join(group, "doc_id").filter(told_by("least(df_t, df_e)") >= GENERALISE_AT - 1e-9)
    scored = pairs.groupBy("term", "g1", "g2", "df_e", "df_t").agg(F.count("*").alias("co")).select("term", told_by("co").alias("share"))
    told = stage(scored.filter(F.col("share") >= GENERALISE_AT).groupBy("term").agg(F.max("share").alias("share")), "told")
    # Few words disclose anything: the others do not go through the shuffle by term.
    found = sieve(words.filter("doc_id is not null"), told, "term", "_told").filter("_told").drop("_told")
    return (
        found.join(told, "term").distinct()
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("term")).alias("terms"), F.sort_array(F.collect_list(F.when(F.col("share") >= REMOVE_AT, F.col("term")))).alias("removed"))
    )


def _words(text: str) -> str:
    return f"array_distinct(regexp_extract_all(lower({text}), {_lit(TERM)}, 0))"


def _term_spans() -> Column:
    """Occurrences of the row's `terms` as whole words, any case; terms hold letters and digits alone."""
    pattern = "concat('(?iu)(?<![\\\\p{L}\\\\p{N}])(?:', array_join(terms, '|'), ')(?![\\\\p{L}\\\\p{N}])')"
    return F.expr(f"if(coalesce(size(terms), 0) > 0, {_spans('_t', pattern)}, {_NONE})")


def _with_terms(docs: DataFrame) -> DataFrame:
    """`docs` with `_t`, the base spans, terms, removed and `_term`, the spans of the terms."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit = with_base(src).filter(" or ".join(f"size(_{k}) > 0" for k in KINDS)).filter("doc_id is not null")
    told = stage(disclosing_terms(stage(hit.drop("text"), "spans"), src), "terms").withColumnRenamed("doc_id", "_id")
    return with_base(docs.join(told, F.col("doc_id").cast("long") == F.col("_id"), "left")).withColumn("_term", _term_spans())


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, base, terms, removed) of every document.

    Null texts count as empty. base and spans list kind:start:end in code points, end exclusive; spans
    adds the kind `term` after the base kinds. Rows with a null doc_id have base spans only, rows with
    the same doc_id share their disclosing terms; repeated rows come back as often as they came.
    Columns of `docs` other than doc_id and text are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = _with_terms(src).drop("text", "_t", "_id")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    base = joined(*KINDS)
    return both.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(*KINDS, "term").alias("spans"), F.size("_term").cast("long").alias("n_term"), base.alias("base"), "terms", "removed"
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data replaced in `text`: base spans by [EMAIL], [IP], [CARD] or [PHONE], disclosing terms by
    [TERM], or by nothing where they disclose almost all; overlapping spans are replaced once. n_chars, if there,
    is counted anew. Null texts stay null; the columns, their order and the rows stay."""
    prepare(docs.sparkSession)
    out = _with_terms(docs)
    marks = [f"transform(_{k}, x -> named_struct('start', x.start, 'end', x.end, 'm', '[{k.upper()}]'))" for k in KINDS]
    marks.append("transform(_term, x -> named_struct('start', x.start, 'end', x.end, 'm', if(array_contains(removed, lower(x.m)), '', '[TERM]')))")
    out = out.withColumn("_marks", F.expr(f"array_sort(concat({', '.join(marks)}))"))
    clean = _replaced("_marks")
    out = out.withColumn("_new", F.when(F.col("text").isNotNull(), F.when(F.size("_marks") > 0, F.expr(clean)).otherwise(F.col("text"))))
    cols = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns])
