import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from periodica.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def puzzles_of(spark):
    """Puzzle table from (id, setter, date, type) rows; number is the id's last part."""

    def build(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(
            rows, "id string, creator_name string, date string, crossword_type string"
        )
        return df.select(
            "id",
            F.element_at(F.split("id", "/"), -1).alias("number"),
            "creator_name",
            F.col("date").cast("date").alias("date"),
            "crossword_type",
            F.when(F.col("crossword_type") == "prize", F.concat(F.lit("pdf/"), "id")).alias("pdf"),
        )

    return build


@pytest.fixture(scope="session")
def entries_of(spark):
    """Entry table from (puzzle, number, direction, clue, solution) rows."""

    def build(rows):
        full = [
            (p, f"{n}-{d}", int(n) if n.isdigit() else 0, n, c, d, len(s), s, 0, 0)
            for p, n, d, c, s in rows
        ]
        return spark.createDataFrame(
            full,
            "crossword_id string, entry_id string, number int, human_number string, "
            "clue string, direction string, length int, solution string, pos_x int, pos_y int",
        )

    return build
