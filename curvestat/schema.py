"""Logical schemas of the curve data model."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _I, _S, _B = T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType()


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TRIAL = _of(("participant", _I), ("action", _I), ("trial", _I), ("global_index", _I), ("raw_length", _I), ("keep", _B))
CURVE = _of(("waveform", _S), ("participant", _I), ("action", _I), ("trial", _I), ("y", T.ArrayType(_D)))
CURVE_NODE = _of(("waveform", _S), ("participant", _I), ("action", _I), ("trial", _I), ("node", _I), ("y", _D))
COMPONENT = _of(("waveform", _S), ("action", _I), ("node", _I), ("msb", _D), ("msw", _D), ("ssb", _D), ("ssw", _D), ("sigma2_b", _D), ("sigma2_w", _D), ("interior", _B))
DRAWS = _of(("rep", _I), ("participant", _I), ("cnt", _I))

#: Action identifiers with their codes and labels.
ACTION_CODES = {1: "FA", 2: "FD", 3: "FP", 4: "BA", 5: "BD", 6: "BP"}
ACTION_LABELS = {1: "forehand attack", 2: "forehand drive", 3: "forehand push", 4: "backhand attack", 5: "backhand drive", 6: "backhand push"}
#: Joint labels in the order of the coordinate columns.
JOINTS = ("Hips", "Head", "LeftShoulder", "LeftArm", "LeftForeArm", "RightShoulder", "RightArm", "RightForeArm", "LeftUpLeg", "LeftLeg", "LeftFoot", "RightUpLeg", "RightLeg", "RightFoot")
#: First and last code of each cohort scenario.
SCENARIOS = {"codes_1_30_primary": (1, 30), "codes_11_40_alternative_window": (11, 40), "codes_1_40_all_archive_codes": (1, 40)}
#: Joints of the array variants, and the fewest of them an interval needs.
VARIANTS = {"all14": (tuple(range(1, 15)), 10), "fixed8": ((1, 2, 3, 4, 5, 6, 11, 14), 8), "fixed13": ((1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14), 9)}
