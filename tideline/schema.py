"""Keys, whitelists, thresholds and column types of the observation table."""

from __future__ import annotations

from pyspark.sql import types as T

# Keys, whitelists and the partition count of the table.
BUSINESS_KEY = ("cik", "tag", "ddate", "qtrs", "uom")
PRIMARY_KEY = ("adsh", "tag", "ddate", "qtrs", "uom")
FILING_KEY = (*BUSINESS_KEY, "adsh")
FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
QTRS = (0, 1, 2, 3, 4)
BUCKETS = 16

# Fixed values of the statistics.
THRESHOLDS = (0.0, 1e-6, 1e-4, 1e-2)
QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
LAG_EDGES = (60, 130, 300, 400, 700, 760)
LAG_LABELS = ("0-59", "60-129", "130-299", "300-399", "400-699", "700-759", "760+")
SCALE_EXPONENTS = (-9, -6, -3, 3, 6, 9)
SCALE_LOG_TOLERANCE = 1e-6
COMPARATIVE_GAP_DAYS = 31
RIGHT_TRUNCATION_DAYS = 365
MIN_TAG_SAMPLE = 1000

# The members of a quarterly archive and their columns, in order.
SUB_COLUMNS = tuple(
    "adsh cik name sic countryba stprba cityba zipba bas1 bas2 baph countryma stprma cityma zipma mas1 mas2 countryinc stprinc ein former changed afs wksi fye form period fy fp filed accepted prevrpt detail instance nciks aciks".split()
)
NUM_COLUMNS = tuple("adsh tag version ddate qtrs uom segments coreg value footnote".split())
TAG_COLUMNS = tuple("tag version custom abstract datatype iord crdr tlabel doc".split())
MEMBERS = {"sub.txt": SUB_COLUMNS, "num.txt": NUM_COLUMNS, "tag.txt": TAG_COLUMNS}

OBSERVATIONS = T.StructType(
    [
        T.StructField("cik", T.LongType()),
        T.StructField("adsh", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("filed", T.DateType()),
        T.StructField("accepted", T.TimestampNTZType()),
        T.StructField("period", T.DateType()),
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("ddate", T.DateType()),
        T.StructField("qtrs", T.ByteType()),
        T.StructField("uom", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("filed_year", T.IntegerType()),
    ]
)
OBSERVATION_COLUMNS = tuple(OBSERVATIONS.names)
