"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document, under a softmax trained by numpy SGD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import subword

#: Case stays: shouting is a sign of quality.
BAG = subword.Bag(sizes=(2, 3, 4), words=2, fold=False, bits=18)
TRAINING = subword.Training()
#: Scores from here on are good.
THRESHOLD = 0.3


def scores(docs: DataFrame, labels: DataFrame, columns: list[str], label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", training: subword.Training = TRAINING, source: DataFrame | None = None) -> DataFrame:
    """The columns of docs, score (the probability that the text is good) and predicted (1 from THRESHOLD on).

    Learns from the rows of labels alone, whichever the caller passes, with the texts that source (docs, unless given) has for them. Null and empty texts are scored too, by the bias; rows without
    labels, null ids and repeated rows are scored like others. Columns named score or predicted in docs give way to the results.
    """
    model = subword.fit(source or docs, labels, BAG, training, id_col, text_col, label_col)
    out = subword.score(docs, model, BAG, [c for c in columns if c not in ("score", "predicted")], text_col)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
