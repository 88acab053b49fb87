"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences; each is normalised (lower case, comment signs
and white space as one space) and mapped to the identifiers of all known licence
sentences in it, by position: where no full stop stands between two of them
(lists, headings, lines), it holds several.  The identifiers, in order, are
matched against the licence rules, each an ordered list of sentences; the longest rule is tried
first where several begin at one place.  What no rule takes is reported as
partial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textflow.llm.stored import pick

#: Known sentences, by a pattern that the normalised sentence contains.
SENTENCES = {
    "mit_name": r"(licensed|released|distributed|available) under (the )?(terms of the )?mit licen[cs]e",
    "apache2_name": r"licensed under (the )?(terms of the )?apache licen[cs]e,? (version )?2(\.0)?",
    "gpl2_name": r"licensed under (the )?(terms of the )?gnu general public licen[cs]e,? version 2",
    "gpl3_name": r"licensed under (the )?(terms of the )?gnu general public licen[cs]e,? version 3",
    "cc_by_nc_4": r"licensed under (a )?cc by-nc 4\.0",
    "cc_by_4": r"licensed under (a )?cc by 4\.0",
    "mit_grant": r"permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit_notice": r"the above copyright notice and this permission notice shall be included in all copies",
    "as_is": r"the software is provided .as is., without warranty of any kind",
    "bsd_grant": r"redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd_source": r"redistributions of source code must retain the above copyright notice",
    "bsd_binary": r"redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": r"neither the name of .* may be used to endorse or promote products",
    "gpl_free": r"is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e",
    "gpl_hope": r"is distributed in the hope that it will be useful, but without any warranty",
}
#: Licences as ordered sentences.
RULES = {
    "MIT": [["mit_grant", "mit_notice", "as_is"], ["mit_grant", "mit_notice"], ["mit_name"]],
    "BSD-3-Clause": [["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]],
    "BSD-2-Clause": [["bsd_grant", "bsd_source", "bsd_binary"]],
    "GPL": [["gpl_free", "gpl_hope"], ["gpl_free"]],
    "GPL-2.0": [["gpl2_name"]],
    "GPL-3.0": [["gpl3_name"]],
    "Apache-2.0": [["apache2_name"]],
    "CC-BY-NC-4.0": [["cc_by_nc_4"]],
    "CC-BY-4.0": [["cc_by_4"]],
}
#: Every known sentence has one of these words.
WORDS = ["licens", "licenc", "permission", "copyright", "the software", "redistribut", "endorse", "warranty"]
SPACE = r"[ \t\r\n\f]"
#: White space, with comment signs between; one class repeated and no group, so that a match needs no stack.
BREAK = SPACE + r"(?:[ \t\r\n\f*#/;]*" + SPACE + ")?"


def _letter(sentence: str) -> str:
    """Identifiers are single letters in a sequence."""
    return chr(ord("A") + list(SENTENCES).index(sentence))


def _ordered() -> list[tuple[str, str]]:
    """(sequence, licence), longest sequences first."""
    rules = [("".join(map(_letter, seq)), name) for name, seqs in RULES.items() for seq in seqs]
    return sorted(rules, key=lambda r: (-len(r[0]), r[0]))


def identifiers(text: Column) -> Column:
    """The letters of all known sentences of a text, in the order of their places."""
    flat = F.regexp_replace(F.lower(text), BREAK, " ")
    sentences = F.split(F.regexp_replace(flat, "([.!?]) ", "$1\n"), "\n", -1)

    # the lookahead takes no characters, so that sentences that overlap are all found
    known = F.lit("(?=(" + "|".join(SENTENCES.values()) + "))")

    def letter(s):
        out = F
        for name, pattern in SENTENCES.items():
            out = out.when(s.rlike(f"^(?:{pattern})"), F.lit(_letter(name)))
        return out

    found = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, known, F.lit(1))))
    return F.array_join(F.transform(found, letter), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_sentences, n_licenses, licenses, partial) of every row.

    n_sentences: known sentences; licenses: the distinct licences in
    alphabetical order, with commas; n_licenses: rules that matched, repeats
    counted; partial: known sentences that no rule took, in order.  A null or
    empty text has none.  Ids, null or repeated ones too, are passed through;
    an empty table gives an empty result."""
    rows = pick(docs, {"id": id_col, "text": text_col})
    low = rows.withColumn("low", F.lower("text"))
    worth = F.lit(False)
    for word in WORDS:
        worth = worth | F.contains("low", F.lit(word))
    found = low.withColumn("sequence", F.when(worth, identifiers(F.col("low"))).otherwise(F.lit(""))).drop("low", "text")
    rules = _ordered()
    taken = F.regexp_extract_all("sequence", F.lit("|".join(seq for seq, _ in rules)), F.lit(0))
    named = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    names = F.create_map(*[F.lit(x) for name in SENTENCES for x in (_letter(name), name)])
    rest = F.regexp_replace("sequence", "|".join(seq for seq, _ in rules), "")
    return found.withColumn("taken", taken).select(
        F.col("id").alias(id_col), F.length("sequence").cast("long").alias("n_sentences"), F.size("taken").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("taken", lambda t: named[t]))), ",").alias("licenses"),
        F.array_join(F.transform(F.split(rest, ""), lambda c: names[c]), ",").alias("partial"))


def scan_sql(table: str = "documents") -> str:
    """The scan in DuckDB SQL, for texts with at most one known sentence up to each full stop."""
    cases = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{_letter(n)}'" for n, p in SENTENCES.items())
    rules = _ordered()
    any_rule = "|".join(seq for seq, _ in rules)
    named = "MAP {" + ", ".join(f"'{s}': '{n}'" for s, n in rules) + "}"
    names = "MAP {" + ", ".join(f"'{_letter(n)}': '{n}'" for n in SENTENCES) + "}"
    return f"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{BREAK}', ' ', 'g'), '([.!?]) ', '\\1' || chr(10), 'g') AS t FROM {table}),
s AS (SELECT doc_id, list_aggregate(list_transform(string_split(t, chr(10)), lambda x: CASE {cases} ELSE '' END), 'string_agg', '') AS q FROM f),
k AS (SELECT doc_id, q, regexp_extract_all(q, '{any_rule}') AS taken, regexp_replace(q, '{any_rule}', '', 'g') AS rest FROM s)
SELECT doc_id, length(q) AS n_sentences, len(taken) AS n_licenses,
  coalesce(list_aggregate(list_sort(list_distinct(list_transform(taken, lambda x: {named}[x]))), 'string_agg', ','), '') AS licenses,
  coalesce(list_aggregate(list_transform(regexp_extract_all(rest, '.'), lambda x: {names}[x]), 'string_agg', ','), '') AS partial
FROM k"""
