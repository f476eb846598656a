"""Schemas of the files and tables the package reads and writes."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LABELLED = _schema(id=T.LongType(), text=T.StringType(), label=T.IntegerType(), project=T.StringType())

# Column names of the raw function datasets.
RAW_SPLIT_CSV = _schema(processed_func=T.StringType(), target=T.IntegerType(), project=T.StringType())
RAW_ONE_JSON = _schema(
    func=T.StringType(), target=T.IntegerType(), project=T.StringType(), commit_id=T.StringType()
)
RAW_TWO_JSON = _schema(code=T.StringType(), project=T.StringType(), hash=T.StringType(), size=T.IntegerType())
FLAT = _schema(func=T.StringType(), vul=T.IntegerType())

# Column names of a metrics file.
METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "f2", "roc_auc"]
METRICS_CSV = _schema(**{name: T.DoubleType() for name in METRIC_NAMES})
EPOCH_LOG = _schema(
    run=T.StringType(),
    epoch=T.LongType(),
    loss=T.DoubleType(),
    f1=T.DoubleType(),
    val_loss=T.DoubleType(),
    val_f1=T.DoubleType(),
)

# The ten seeds of a repeated study.
SEEDS = [123456, 789012, 345678, 901234, 567890, 123, 456, 789, 135, 680]
