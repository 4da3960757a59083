"""Column helpers shared by the operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that separate words, and the pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column="text"):
    """The text, empty if null."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value, body):
    """Bind ``value`` once as a lambda variable, so that ``body`` may use it often without evaluating it again."""
    return F.transform(F.array(value), body)[0]


def words(text):
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def has_word(text):
    return F.translate(text, SPACES, "") != ""


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
