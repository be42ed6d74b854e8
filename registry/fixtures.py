"""Inputs of the registered queries, built by Spark from the given tables.

The tables hold prose, mail-like turns and web pages, not code. ``code_samples`` puts every document's whole text, as
comment lines, below one of twelve small programs, so the code features have something to count and the work still
grows with the texts. All other inputs are the tables themselves under the names the operators expect.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Program templates by doc_id % 12; "~" is a newline, "^" a tab, "@" the document number.
TEMPLATES = [
    'def load_rows_@(path: str, limit=None):~    if path is None:~        return None~    rows = [r for r in open(path)]~    return rows[:limit]~',
    '# Step 1. Read the input~import sys~~def main():~    # TODO handle errors~    try:~        x = int(input())~    except Exception:~        return None~    finally:~        pass~    print(f"v{x}")~~if __name__ == "__main__":~    main()~',
    'n=int(input())~a=list(map(int,input().split()))~print(sum(a)-n*@)~',
    'class LRUCache@:~    """Cache."""~    def __init__(self, cap=0):~        self.cap = cap~        self.maxCapacityValueHolder = cap~~    def get(self, k):~        if not isinstance(k, int):~            return~        for i in range(k):~            while i:~                i -= 1~        return k~',
    'Here is the solution:~```python~print(@)~```~',
    'public class A@ {~  // entry~  int f(String s) {~    if (s == null) {~      throw new E();~    }~    try { return 1; } catch (Exception e) { return 0; }~  }~}~',
    '#include <cstdio>~int main(){ // go~  return 0;~}~',
    'import os, re~from typing import Any~G = 0~async def f_@(a: Any, *, b=None) -> int:~    global G~    assert a is not None~    if (m := a) and b is None:~        return~    g = lambda q: q~    return {k: v for k, v in [(m, g)]}~',
    'import logging~logger = logging.getLogger()~def run@(d={}):~    try:~        logger.error("bad")~    except ValueError:~        raise~    except:~        logging.info("x")~',
    'def f():~^return 1   ~~   ~',
    '   ~~',
    'def h_@(x):~    if x == 1:~        return None~    elif x == 2:~        with open(str(x)) as fh:~            return fh~    elif len(x) == 0:~        return~    return x~',
]
# Templates of other languages, and templates that count as AI-written.
LANGUAGES = {5: "java", 6: "c++"}
AI_TEMPLATES = [0, 1, 3, 7, 8]
EMBEDDING_FEATURES = [f"f{i:02d}" for i in range(64)]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 12
    program = F.lit(None).cast("string")
    for number, template in enumerate(TEMPLATES):
        program = F.when(kind == number, F.lit(template)).otherwise(program)
    doc = F.col("doc_id").cast("string")
    for mark, value in (("~", F.lit("\n")), ("^", F.lit("\t")), ("@", doc)):
        program = F.replace(program, F.lit(mark), value)
    comment = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\n"))
    language = F.lit("Python")
    for number, name in LANGUAGES.items():
        language = F.when(kind == number, name).otherwise(language)
    label = F.when(kind.isin(AI_TEMPLATES), 1).otherwise(0)
    return docs.select(
        F.lit("code").alias("corpus"), doc.alias("sample_id"),
        F.when(kind == 10, program).otherwise(F.concat(program, comment)).alias("code"),
        language.alias("language"),
        F.when(label == 1, F.concat(F.lit("gen"), (F.col("doc_id") % 5).cast("string"))).alias("generator"),
        label.alias("label"), "doc_id")


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("code"),
        F.col("lang").alias("language"), F.col("source").alias("generator"))


def corpus_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.lit("a").alias("corpus"), F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("code"),
        F.col("lang").alias("language"), F.col("source").alias("generator"), F.col("quality").alias("label"))


def corpus_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_anti").select(
        F.lit("b").alias("corpus"), F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("code"),
        F.col("lang").alias("language"), F.col("source").alias("generator"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return turns.select(
        F.lit("paired").alias("corpus"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("sample_id"),
        F.col("text").alias("code"), F.lit("text").alias("language"), F.lit(None).cast("string").alias("generator"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label"),
        F.col("conv_id").alias("problem_id"), F.col("turn").alias("source_file"))


def third(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(df, key, text, label):
        return df.select(
            F.lit("third").alias("corpus"), F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("sample_id"),
            F.col(text).alias("code"), F.lit("text").alias("language"),
            F.lit(None).cast("string").alias("generator"), F.lit(label).alias("label"))
    return part(table(spark, sf_dir, "benchmark"), "item_id", "text", 0).unionByName(
        part(table(spark, sf_dir, "pages"), "page_id", "html", 1))


def matrix_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label",
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(EMBEDDING_FEATURES)])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    number = lambda prefix, n: F.concat(F.lit(prefix), (v % n).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label"),
        F.when(v % 4 == 0, (F.col("label") + v % 3) % 10).otherwise(F.col("label")).cast("int").alias("prediction"),
        (v % 5).alias("fold"), number("c", 3).alias("corpus"), number("gen", 7).alias("generator"))


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("pos"), (-F.col("value") / 100).alias("logprob"))
