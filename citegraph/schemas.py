"""Fixed schemas of the raw records, the bucketed layers and the result tables."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType,
)

STRINGS = ArrayType(StringType())


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def with_corrupt_record(schema: StructType) -> StructType:
    """The schema plus the column that takes lines which do not parse."""
    return StructType([*schema.fields, StructField("_corrupt_record", StringType())])


RAW_ABSTRACT = _struct(corpusid=LongType(), abstract=StringType())

RAW_EDGE = _struct(
    citationid=LongType(), citingcorpusid=LongType(), citedcorpusid=LongType(), isinfluential=BooleanType(),
    contexts=STRINGS, intents=ArrayType(STRINGS),
)

# ``journal`` is read as text: some records carry a plain string instead of an object.
RAW_PAPER = _struct(
    corpusid=LongType(),
    externalids=_struct(ACL=StringType(), DOI=StringType(), ArXiv=StringType()),
    title=StringType(),
    authors=ArrayType(_struct(name=StringType())),
    year=IntegerType(), publicationdate=StringType(), venue=StringType(), publicationvenueid=StringType(),
    journal=StringType(), referencecount=IntegerType(), citationcount=IntegerType(),
    influentialcitationcount=IntegerType(), isopenaccess=BooleanType(),
    s2fieldsofstudy=ArrayType(_struct(category=StringType())),
    publicationtypes=STRINGS,
)

EDGES = _struct(
    citedcorpusid=LongType(), citingcorpusid=LongType(), isinfluential=BooleanType(), contexts=STRINGS,
    intents=ArrayType(STRINGS), bucket=IntegerType(),
)
ABSTRACTS = RAW_ABSTRACT
EDGES_RAW = RAW_EDGE
PAPERS = _struct(
    corpusid=LongType(), acl_id=StringType(), doi=StringType(), arxiv=StringType(), title=StringType(),
    authors=STRINGS, year=IntegerType(), publicationdate=StringType(), venue=StringType(),
    publicationvenueid=StringType(), journal_name=StringType(), referencecount=IntegerType(),
    citationcount=IntegerType(), influentialcitationcount=IntegerType(), isopenaccess=BooleanType(),
    s2fieldsofstudy=STRINGS, publicationtypes=STRINGS,
)
ACL_IDS = _struct(
    corpusid=LongType(), acl_id=StringType(), doi=StringType(), arxiv=StringType(), venue=StringType(),
    publicationvenueid=StringType(),
)

# The paper columns carried into the corpus tables.
PAPER_COLUMNS = [
    "title", "authors", "year", "publicationdate", "venue", "journal_name", "referencecount", "citationcount",
    "influentialcitationcount", "s2fieldsofstudy", "publicationtypes",
]

BENCHMARK_CITER = _struct(
    id=StringType(), acl_id=StringType(), title=StringType(), abstract=StringType(), year=IntegerType(),
    venue=StringType(), citationcount=IntegerType(), fields=STRINGS, isinfluential=BooleanType(), intents=STRINGS,
    n_contexts=IntegerType(),
)
BENCHMARK = _struct(
    seed_id=StringType(), acl_id=StringType(), seed_title=StringType(), seed_abstract=StringType(),
    seed_authors=STRINGS, seed_year=IntegerType(), seed_venue=StringType(), seed_citationcount=IntegerType(),
    seed_influentialcitationcount=IntegerType(), seed_fields=STRINGS, n_citers_qualifying=LongType(),
    citers=ArrayType(BENCHMARK_CITER), part=IntegerType(),
)
GENERATION_RECORD = _struct(seed_id=StringType(), condition=StringType(), model=StringType(), predictions=STRINGS)
CITER_LABELS = _struct(citer_id=StringType(), labels=STRINGS)
GENERATION_LABELS = _struct(condition=StringType(), seed_id=StringType(), labels=ArrayType(STRINGS))
MATCH_ROW = _struct(
    condition=StringType(), mode=StringType(), seed_id=StringType(), citer_id=StringType(), n_gen=IntegerType(),
    probs=ArrayType(FloatType()),
)
PAIR_SCORE = _struct(
    condition=StringType(), mode=StringType(), seed_id=StringType(), citer_id=StringType(), citer_year=IntegerType(),
    citer_pubdate=StringType(), n_gen=IntegerType(), m=IntegerType(), best_cos=DoubleType(),
)
SEED_SCORE = _struct(condition=StringType(), seed_id=StringType(), n_gen=IntegerType(), vendi=DoubleType())
