"""Text search over embedded components: ranked results, symbols, related tests and patterns.

Vectors are computed once and stored; a query is embedded on the driver and compared with all of them in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.embedding import embed, hashed
from codeloom.functions.text import document_text
from codeloom.operators.files import is_test_file
from codeloom.operators.vectors import top_k

META = ["id", "file", "type", "name", "language", "start_line", "end_line", "signature", "exported", "callees", "imports"]


def vector_table(components: DataFrame, provider=hashed) -> DataFrame:
    """id, metadata columns and `embedding` of each component, once each."""
    c = components.dropDuplicates(["id"])
    text = document_text(F.col("type"), F.col("name"), F.col("text"))
    return c.select(*META, embed(text, provider).alias("embedding"))


def search(vectors: DataFrame, query: str, k: int = 10, threshold: float = 0.0, provider=hashed) -> DataFrame:
    """The k nearest components; of these, those with at least the threshold's score."""
    return top_k(vectors, provider([query])[0].tolist(), k, threshold, "id", "embedding")


def find_symbol(vectors: DataFrame, name: str, provider=hashed) -> DataFrame:
    """Of the ten nearest the first whose name is the symbol, else whose path or signature holds it, else the nearest."""
    hit = F.when(F.col("name") == name, 0).when(F.contains("file", F.lit(name)) | F.contains("signature", F.lit(name)), 1).otherwise(2)
    return search(vectors, name, 10, provider=provider).orderBy(hit, "distance", "id").limit(1)


def related_test_components(vectors: DataFrame, query: str, provider=hashed) -> DataFrame:
    """Test files among the nearest of four phrasings, five each, in order of their best rank."""
    found = None
    for i, q in enumerate((f"test {query}", f"{query} test", f"{query} spec", f"describe {query}")):
        x = search(vectors.filter(is_test_file(F.col("file"))), q, 5, provider=provider).select("file", "distance", F.lit(i).alias("q"))
        found = x if found is None else found.unionByName(x)
    return found.groupBy("file").agg(F.min("distance").alias("distance")).orderBy("distance", "file")


def similar_to_path(vectors: DataFrame, path: str, n: int = 10, threshold: float = 0.75, provider=hashed) -> DataFrame:
    """Components nearest to a path taken as text: one more than wanted is fetched, those of the file itself fall out."""
    return search(vectors, path, n + 1, threshold, provider).filter(F.col("file") != path).orderBy("distance", "id").limit(n)


def search_suffix(vectors: DataFrame, query: str, suffixes: list[str], k: int = 10, threshold: float = 0.7, provider=hashed) -> DataFrame:
    ends = [F.col("file").endswith(s) for s in suffixes]
    cond = ends[0]
    for e in ends[1:]:
        cond = cond | e
    return search(vectors, query, k, threshold, provider).filter(cond)
