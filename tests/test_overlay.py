"""Settings tables longer than the settings, and ones that contradict themselves."""

import pytest

from habitspark.operators import models

KIND = "algo string, parameter string, value string"


def test_long_settings_table(spark):
    rows = [("glm", "C", "2.5")] * 1500
    assert models.read_overlay(spark.createDataFrame(rows, KIND)) == {"glm": {"C": 2.5}}
    unknown = rows + [("glm", f"made_up_{i}", "1") for i in range(1200)]
    with pytest.raises(ValueError, match="has no setting made_up_"):
        models.read_overlay(spark.createDataFrame(unknown, KIND))
    with pytest.raises(ValueError, match="glm C needs one value"):
        models.read_overlay(spark.createDataFrame([*rows, ("glm", "C", "3")], KIND))
    with pytest.raises(ValueError, match="glm C needs one value"):
        models.read_overlay(spark.createDataFrame([("glm", "C", None)], KIND))
