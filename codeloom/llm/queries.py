"""Queries p1 to p9 but p3, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.io import table

from . import function_docs, generated_files, leaks, lookalikes, near_duplicates, packing, splitting, unparsable_files


def p1_found(spark, d):
    return generated_files.classify_files(table(spark, d, "source_files")).filter("not hand_written").select(F.col("path").alias("file_path"))


def p1_reasons(spark, d):
    x = generated_files.marked_mentions(*(table(spark, d, t) for t in ("source_files", "components", "code_metadata")))
    return x.groupBy(F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(
        F.count("*").alias("n_files"), F.sum("n_components").alias("n_components"), F.sum("max_lines_of_code").alias("lines_of_code")
    )


def p1_evidence(spark, d):
    return generated_files.evidence(table(spark, d, "source_files"))


def p2_found(spark, d):
    return function_docs.component_pairs(table(spark, d, "components")).select("id")


def p2_pairs(spark, d):
    return function_docs.component_pairs(table(spark, d, "components")).drop("language")


def p2_functions(spark, d):
    return function_docs.source_functions(table(spark, d, "source_files"))


def p4_found(spark, d):
    return near_duplicates.pairs_of_records(*near_duplicates.near_duplicates(table(spark, d, "components")))


def p4_classes(spark, d):
    return near_duplicates.linked_classes(*near_duplicates.near_duplicates(table(spark, d, "components")))


def p4_copies(spark, d):
    return near_duplicates.classes_of_copies(table(spark, d, "components"))


def p4_links(spark, d):
    return near_duplicates.near_duplicates(table(spark, d, "components"))[0]


def p5_found(spark, d):
    x = splitting.split_oversized(table(spark, d, "components"), ["snippet", "text"])
    return x.filter("piece = 0").select("id", "field_name").distinct()


def p5_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "components"), ["snippet", "text"])


def p5_cover(spark, d):
    return splitting.cover(splitting.split_oversized(table(spark, d, "components"), ["snippet", "text"]))


def p6_found(spark, d):
    return unparsable_files.parse_verdicts(table(spark, d, "source_files")).filter("not valid").select("path")


def p6_rates(spark, d):
    return unparsable_files.failure_rates(table(spark, d, "source_files"))


def p7_packed(spark, d):
    return packing.packed(table(spark, d, "documents"))


def p7_report(spark, d):
    return packing.fill_report(packing.packed(table(spark, d, "documents")))


def p7_checked(spark, d):
    return packing.checked(packing.packed(table(spark, d, "documents")))


def p8_found(spark, d):
    x = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), proximity=False)
    return x.select("doc_id", "item_id")


def p8_matches(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leaked_items(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return lookalikes.links_between_forms(lookalikes.classes_of_documents(table(spark, d, "documents")), "doc_id")


def p9_classes(spark, d):
    return lookalikes.classes_of_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_evidence, p2_found, p2_pairs, p2_functions, p4_found, p4_classes, p4_copies, p4_links, p5_found, p5_pieces, p5_cover, p6_found, p6_rates, p7_packed, p7_report, p7_checked, p8_found, p8_matches, p8_leaked_items, p9_found, p9_classes)}

# ---- SQL, written apart from the operators --------------------------------------------------------------------
# Letters drawn alike, one under the other.
_DRAWN = "АВЕКМНОРСТУХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο²①Ёё"
_PLAIN = "ABEKMHOPCTYXSIJaeopcyxsijABEZHIKMNOPTYXo21Ëë"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_FORM = (
    "nfc_normalize(translate(translate(regexp_replace(regexp_replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{FE0F}]', '', 'g'),"
    f" '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), '{_DRAWN}', '{_PLAIN}'), '{_WIDE}', '{_ASCII}'))"
)
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = rf"""WITH c AS (SELECT id, min(snippet) AS snippet FROM components WHERE type IN ('function', 'method') AND snippet IS NOT NULL AND id IS NOT NULL GROUP BY id),
t AS (SELECT id, regexp_extract_all(snippet, '[A-Za-z0-9_]+|[^{_SPACE}A-Za-z0-9_]') AS t FROM c), k AS (SELECT id, t FROM t WHERE len(t) >= 40)"""
_NINE = f"WITH n AS (SELECT DISTINCT doc_id, text, md5({_FORM}) AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"
_GRAMS = "SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM {0} WHERE len(w) >= 12)"
_WORDS = "regexp_extract_all(lower(" + _FORM + "), '[\\p{L}\\p{N}]+')"
SQL: dict[str, str] = {
    "p4_found": _TOKENS + """, s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: hash(t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2])))) AS h FROM k),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), b AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM b JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE shared >= 0.6 * (x.n + y.n - shared)""",
    "p4_copies": _TOKENS + ", m AS (SELECT id, md5(array_to_string(t, chr(1))) AS h FROM k) SELECT id, min(id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS n_copies FROM m",
    "p4_classes": "WITH RECURSIVE " + _TOKENS.removeprefix("WITH ") + """, s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: hash(t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2])))) AS h FROM k),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), b AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.id <> b.id GROUP BY ALL),
e AS (SELECT b.x, b.y FROM b JOIN n p ON p.id = b.x JOIN n q ON q.id = b.y WHERE shared >= 0.6 * (p.n + q.n - shared)),
r AS (SELECT id, id AS other FROM k UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.other),
m AS (SELECT id, md5(array_to_string(t, chr(1))) AS h FROM k), c2 AS (SELECT id, min(id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS n_copies FROM m)
SELECT c2.*, component_id, coalesce(n_links, 0) AS n_links FROM c2 JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) USING (id) LEFT JOIN (SELECT x AS id, count(*) AS n_links FROM e GROUP BY x) USING (id)""",
    "p5_found": "SELECT DISTINCT id, 'snippet' AS field_name FROM components WHERE length(snippet) > 2000 UNION ALL SELECT DISTINCT id, 'text' FROM components WHERE length(text) > 2000",
    "p5_cover": "SELECT DISTINCT id, 'snippet' AS field_name, length(snippet)::INT AS n_chars, md5(snippet) AS digest, true AS fits FROM components WHERE length(snippet) > 2000 UNION ALL SELECT DISTINCT id, 'text', length(text)::INT, md5(text), true FROM components WHERE length(text) > 2000",
    "p7_checked": "SELECT DISTINCT doc_id, true AS whole, true AS fits FROM documents WHERE text <> '' AND doc_id IS NOT NULL",
    "p8_found": f"WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), e AS (SELECT item_id AS id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM eval_items)), x AS ({_GRAMS.format('d')}), y AS ({_GRAMS.format('e')}) SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM x JOIN y USING (g)",
    "p8_leaked_items": f"WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), e AS (SELECT item_id AS id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM eval_items)), x AS ({_GRAMS.format('d')}), y AS ({_GRAMS.format('e')}), f AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM x JOIN y USING (g)),"
    """ dw AS (SELECT id AS doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d WHERE id IN (SELECT doc_id FROM f)), iw AS (SELECT id AS item_id, unnest(w) AS word, unnest(range(0, len(w))) AS off FROM e),
m AS (SELECT doc_id, item_id, pos - off AS shift, off FROM f JOIN dw USING (doc_id) JOIN iw USING (item_id, word)),
i AS (SELECT *, off - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY off) AS island FROM m), r AS (SELECT item_id, count(*) AS run FROM i GROUP BY doc_id, item_id, shift, island)
SELECT item_id, n_documents, longest_run, suite, kind FROM (SELECT item_id, count(DISTINCT doc_id) AS n_documents FROM f GROUP BY 1) JOIN (SELECT item_id, max(run) AS longest_run FROM r GROUP BY 1) USING (item_id) JOIN (SELECT DISTINCT item_id, suite, kind FROM eval_items) USING (item_id)""",
    "p9_found": _NINE + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM n a JOIN n b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p9_classes": _NINE + ", g AS (SELECT form, count(*) AS n_documents, count(DISTINCT text) AS n_forms FROM n GROUP BY form) SELECT doc_id, min(doc_id) OVER (PARTITION BY n.form) AS class_id, min(doc_id) OVER (PARTITION BY n.form, text) AS form_id, n_documents, n_forms FROM n JOIN g USING (form)",
}
