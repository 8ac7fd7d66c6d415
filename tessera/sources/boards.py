"""Board files, measurement frames and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import decode_f64_column

BOARD = (
    "board_id string, type string, category string, specification string, seed decimal(20,0), grid struct<rows:int,cols:int>, arbiters struct<consensus:array<string>,primary:string>, "
    "dilemma struct<target:string,neutral_bridge:string,stereotypical_bridge:string,consensus_ok:boolean,arbiter_scores:array<struct<arbiter:string,cos_target_neutral:double,cos_target_stereo:double,satisfies_eq_4_1:boolean>>>, "
    "keycard_audit struct<per_perspective:struct<agent:int,bystander:int,assassin:int>,overlap_ok:boolean,role_gender_independent:boolean>, "
    "cards array<struct<id:int,text:string,human_perspective_role:string,llm_perspective_role:string,category:string,source:string,weat_set:array<string>,covariates:struct<subtlex_freq:double,length:int,wordnet_polysemy:int>>>, measurement_frame_id string"
)
FRAME = "frame_id string, generator_version string, created_at string, encoder struct<name:string,revision:string,pooling:string,normalize:boolean>, gender_axis struct<dim:int,vector_f64_be_hex:string>, mu_bar struct<dim:int,vector_f64_be_hex:string,norm:double,cos_with_axis:double>"
#: Files in a board folder that are not boards.
NOT_BOARDS = ("balance_report.json", "measurement_frame.json")


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Boards of a folder of JSON files, one each; reports, unreadable files and files without an id or cards are left out."""
    rows = spark.read.schema(BOARD).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_name")).where(~F.col("_file").isin(*NOT_BOARDS) & F.col("board_id").isNotNull() & (F.size("cards") > 0)).drop("_file")


def unreadable_boards(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of a folder's files that ``read_boards`` leaves out, but for the reports that are no boards."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value").where(~F.col("file").isin(*NOT_BOARDS))
    doc = F.from_json("value", BOARD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = files.select("file", doc.alias("d"))
    reason = F.when(F.col("d").isNull() | F.col("d._bad").isNotNull(), "not readable").when(F.col("d.board_id").isNull(), "no board id").when(F.coalesce(F.size("d.cards"), F.lit(0)) <= 0, "no cards")
    return rows.select("file", reason.alias("reason")).where("reason is not null")


def card_texts(boards: DataFrame) -> DataFrame:
    """(board_id, texts): the words of each board in the order of its cards."""
    return boards.select("board_id", F.transform(F.array_sort(F.transform("cards", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text")))), lambda c: c["text"]).alias("texts"))


def word_cards(boards: DataFrame) -> DataFrame:
    """One row per card, covariates flattened, no weat set as an empty one, and the lower-cased key all joins use."""
    c = boards.select("board_id", F.explode("cards").alias("c"))
    return c.select(
        "board_id", F.col("c.id").alias("card_id"), "c.text", F.lower("c.text").alias("word_key"), "c.llm_perspective_role", "c.human_perspective_role", "c.category", "c.source",
        F.coalesce("c.weat_set", F.expr("cast(array() as array<string>)")).alias("weat_set"), "c.covariates.subtlex_freq", "c.covariates.length", "c.covariates.wordnet_polysemy",
    )


def roles_by_seat(cards: DataFrame) -> DataFrame:
    """(board_id, word_key, seat, role): seat 0 reads the llm face, seat 1 the human one. A guesser's agents are those of seat 1 - guesser."""
    faces = F.array(F.struct(F.lit(0).alias("seat"), F.col("llm_perspective_role").alias("role")), F.struct(F.lit(1).alias("seat"), F.col("human_perspective_role").alias("role")))
    return cards.select("board_id", "word_key", F.inline(faces))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(FRAME).option("multiLine", True).json(path)
    return rows.select("frame_id", "generator_version", F.to_timestamp("created_at").alias("created_at"), "encoder.*", decode_f64_column("gender_axis.vector_f64_be_hex").alias("axis"), decode_f64_column("mu_bar.vector_f64_be_hex").alias("mu_bar"))


def one_of(col: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value if allowed, else an error that names it and its file."""
    return F.when(col.isin(*allowed), col).otherwise(F.raise_error(F.concat_ws(" ", F.lit(f"unknown {what}"), F.coalesce(col, F.lit("NULL")), F.lit("in"), F.col("_metadata.file_name"))))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word lists merged: distinct sources joined by '; ', sorted weat sets; words whose category, kind or specification disagree are an error."""
    raw = spark.read.schema("word string, gender_category string, word_kind string, source string, weat_set string, specification string").option("header", True).csv(path)
    clean = raw.select(F.lower(F.trim("word")).alias("word"), one_of(F.lower(F.trim("gender_category")), ("male", "female", "neutral"), "category").alias("category"), F.lower(F.trim("word_kind")).alias("kind"), F.trim("source").alias("source"), F.trim("weat_set").alias("weat_set"), F.nullif(F.trim("specification"), F.lit("")).alias("specification")).where("word <> ''")
    key = F.struct("category", "kind", "specification")
    g = clean.groupBy("word").agg(F.min(key).alias("k"), F.max(key).alias("k2"), F.array_sort(F.collect_set("source")).alias("s"), F.array_sort(F.collect_set(F.nullif(F.col("weat_set"), F.lit("")))).alias("weat_set"))
    same = F.when(F.col("k").eqNullSafe(F.col("k2")), F.array_join("s", "; ")).otherwise(F.raise_error(F.concat(F.lit("conflicting rows for "), F.col("word"))))
    return g.select("word", "k.category", "k.kind", "k.specification", same.alias("source"), "weat_set")


def frequency_table(spark: SparkSession, path: str) -> DataFrame:
    """word, zipf, dom_pos of a prepared list; of several rows of a word the last stays; a frequency that is no number is an error."""
    raw = spark.read.schema("word string, zipf string, dom_pos string").option("header", True).csv(path)
    rows = raw.select(F.monotonically_increasing_id().alias("at"), F.lower(F.trim("word")).alias("word"), F.trim("zipf").cast("double").alias("zipf"), F.trim(F.coalesce("dom_pos", F.lit(""))).alias("dom_pos")).where("word <> ''")
    return rows.groupBy("word").agg(F.max_by(F.struct("zipf", "dom_pos"), "at").alias("r")).select("word", "r.zipf", "r.dom_pos")


def frequency_rows(raw: DataFrame, word: str = "Word", zipf: str = "Zipf-value", dom_pos: str = "Dom_PoS_SUBTLEX") -> DataFrame:
    """A raw frequency sheet by column names: word, zipf, dom_pos; rows without a number go, of a word's rows the most frequent stays."""
    rows = raw.select(F.lower(F.trim(F.col(f"`{word}`"))).alias("word"), F.col(f"`{zipf}`").try_cast("double").alias("zipf"), F.trim(F.col(f"`{dom_pos}`")).alias("dom_pos")).where("word <> '' and zipf is not null")
    return rows.groupBy("word").agg(F.max_by(F.struct("zipf", "dom_pos"), F.struct("zipf", "dom_pos")).alias("r")).select("word", "r.zipf", "r.dom_pos")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(word, pole) of an attribute list; blank words go, a pole that is neither is an error that names its line's file; a word on both poles is an error."""
    raw = spark.read.schema("word string, pole string").option("header", True).csv(path).where("trim(coalesce(word, '')) <> ''")
    rows = raw.select(F.lower(F.trim("word")).alias("word"), one_of(F.lower(F.trim("pole")), ("male", "female"), "pole").alias("pole"))
    g = rows.groupBy("word").agg(F.min("pole").alias("a"), F.max("pole").alias("b"))
    return g.select("word", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("both poles: "), F.col("word")))).alias("pole"))


def pole_counts(attributes: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: attributes and loaded words (category) of each pole."""
    count = lambda df, c, kind: df.agg(*[F.count_if(F.col(c) == p).alias(f"{kind}_{p}") for p in ("male", "female")])
    return count(attributes.select("word", "pole").distinct(), "pole", "attributes").crossJoin(count(loaded.select("word", "category").distinct(), "category", "loaded"))  # two single rows


def read_stoplist(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Normalised words of a stoplist, and the SHA-256 of the file's bytes."""
    words = spark.read.option("header", True).csv(path)
    first = words.columns[0]
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()["d"]  # one small file
    return words.select(F.lower(F.trim(F.col(f"`{first}`"))).alias("word")).where("word <> ''").distinct(), digest


def read_manifest(path: str) -> tuple[int, list[str]]:
    """Master seed and dilemma files of a bank's manifest; a seed that is no integer, or a list that holds no strings, is an error."""
    import json

    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    seed, files = doc.get("master_seed"), doc.get("dilemmas")
    if not isinstance(seed, int) or isinstance(seed, bool):
        raise ValueError(f"{path}: master_seed must be an integer")
    if not isinstance(files, list) or not all(isinstance(x, str) for x in files):
        raise ValueError(f"{path}: dilemmas must be a list of file names")
    return seed, list(files)


def playable_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(word, ord) of a token list: first of duplicates, phrases dropped, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))  # a deck is one small file
    tokens = lines.select("ord", F.lower(F.trim("line")).alias("word")).where((F.col("word") != "") & ~F.col("word").rlike(r"\s"))
    return tokens.withColumn("_rn", F.row_number().over(Window.partitionBy("word").orderBy("ord"))).where("_rn = 1").drop("_rn")


def exclusion_reason(tokens: DataFrame, stoplist: DataFrame, loaded: DataFrame) -> DataFrame:
    """Tokens with ``reason``: stoplist before already_loaded, null for survivors."""
    s, l = stoplist.select("word", F.lit(True).alias("_s")).distinct(), loaded.select("word", F.lit(True).alias("_l")).distinct()
    return tokens.join(s, "word", "left").join(l, "word", "left").withColumn("reason", F.when(F.col("_s"), "stoplist").when(F.col("_l"), "already_loaded")).drop("_s", "_l")
