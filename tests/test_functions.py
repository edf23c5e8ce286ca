from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glossmill.functions import names, numbers, scores, status, text


def test_slugs(evaluate):
    assert evaluate(names.slugify("v"), ["My_Awesome Kernel!!!", "--a--", "x"]) == ["my-awesome-kernel", "a", "x"]
    assert evaluate(names.slugify("v", trim=False), ["A b!"]) == ["a-b-"]


@pytest.mark.parametrize(
    "name, version, strategy, expected",
    [
        ("my-kernel", "1.0.0", "overwrite", "my-kernel"),
        ("nllb-inference", "1.0.0", "semver", "nllb-inference-v1-0-0"),
        ("kernel", "2.5.3", "semver", "kernel-v2-5-3"),
        ("train", "5", "experiment", "train-exp-05"),
        ("train", "1", "experiment", "train-exp-01"),
        ("train", "123", "experiment", "train-exp-123"),
        ("train", "x", "experiment", "train-exp-01"),
        ("train", "1", "timestamp", "train-20240131-235958"),
        ("My_Awesome Kernel!!!", "1.0.0", "semver", "my-awesome-kernel-v1-0-0"),
    ],
)
def test_versioned_slug(evaluate, name, version, strategy, expected):
    at = F.lit(datetime(2024, 1, 31, 23, 59, 58))
    assert evaluate(names.versioned_slug("a", "b", "c", at), [(name, version, strategy)], "a string, b string, c string") == [expected]


@pytest.mark.parametrize(
    "current, strategy, part, expected",
    [
        ("1.0.0", "semver", "patch", "1.0.1"),
        ("1.2.3", "semver", "patch", "1.2.4"),
        ("1.0.0", "semver", "minor", "1.1.0"),
        ("2.5.9", "semver", "minor", "2.6.0"),
        ("1.0.0", "semver", "major", "2.0.0"),
        ("5.3.2", "semver", "major", "6.0.0"),
        ("1", "semver", "patch", "1.0.1"),
        ("1.2", "semver", "patch", "1.2.1"),
        ("1", "timestamp", "patch", "2"),
        ("10", "timestamp", "patch", "11"),
        ("5", "experiment", "patch", "6"),
        ("3", "experiment", "patch", "4"),
        ("x", "experiment", "patch", "1"),
        ("1.x", "semver", "patch", None),
    ],
)
def test_bump_version(evaluate, current, strategy, part, expected):
    assert evaluate(names.bump_version("a", "b", part), [(current, strategy)], "a string, b string") == [expected]


def test_refs_and_handles(evaluate):
    assert [tuple(r) for r in evaluate(names.parse_ref("v"), ["raw:1", "v2_augmented", "a:x", "a:"])] == [
        ("raw", 1), ("v2_augmented", None), ("a", None), ("a", None),
    ]
    assert evaluate(names.format_ref("a", "b"), [("raw", 2), ("raw", None), ("raw", 0)], "a string, b int") == ["raw:2", "raw", "raw"]
    strict = evaluate(names.parse_handle("v"), ["o/m/f/x", "o/m/f/x/3", "o/m", "a/b/c/d/e/f"])
    assert [r and tuple(r) for r in strict] == [("o", "m", "f", "x", None), ("o", "m", "f", "x", "3"), None, None]
    loose = evaluate(names.parse_handle("v", lenient=True), ["o/m", "o/m/f/x/3", "alone"])
    assert [r and r["full_handle"] for r in loose] == ["o/m/transformers/default", "o/m/f/x/3", None]


def test_versions_and_families_in_names(evaluate):
    assert evaluate(names.extract_version("v"), ["model-v1-0-10", "m-2.3.4x", "none"]) == ["1.0.10", "2.3.4", "1.0.0"]
    inputs = ["google/ByT5-small", "mT5-base", "flan", "NLLB-600M", "qwen2", "gemma", "bert"]
    assert evaluate(names.detect_by_rules("v", names.FAMILY_RULES), inputs) == ["byt5", "t5", "t5", "nllb", "qwen", "gemma", None]
    assert evaluate(names.needs_task_prefix("v"), ["byt5", "nllb"]) == [True, False]


def test_code_urls(evaluate):
    inputs = [
        "https://www.kaggle.com/code/user/kernel-name", "https://www.kaggle.com/code/user/kernel?x=1&scriptVersionId=123",
        " kaggle.com/code/user/kernel ", "user/kernel", "https://example.com/code/a/b c", "no slug", "https://evil.example/kaggle.com/code/a/b",
    ]
    found = evaluate(names.parse_code_url("v"), inputs)
    assert [r and tuple(r) for r in found] == [
        ("user/kernel-name", None), ("user/kernel", "123"), ("user/kernel", None), ("user/kernel", None), None, None, None,
    ]


def test_sources(evaluate):
    found = evaluate(names.classify_source("v"), ["me/set", "competition-x", "/data/a/train.csv", "a/b/c"])
    assert [tuple(r) for r in found] == [
        ("dataset", "me/set", "/kaggle/input/set/*.csv"), ("competition", "competition-x", "/kaggle/input/competition-x/*.csv"),
        ("local", "train.csv", "/data/a/train.csv"), ("local", "c", "a/b/c"),
    ]


def test_prefix_numbers(evaluate):
    inputs = ["12abc", " 7 ", "2024-01-01", "-1.5e3x", ".5", "abc", "", None, "-Infinity"]
    assert evaluate(numbers.parse_prefix_number("v"), inputs) == [12.0, 7.0, 2024.0, -1500.0, 0.5, None, None, None, float("-inf")]
    assert evaluate(numbers.parse_prefix_integer("v"), ["12.7", "x", "+3", "99999999999999999999"]) == [12, None, 3, None]


def test_fixed_decimals_round_the_exact_value(evaluate):
    inputs = [0.125, 1.005, 1.335, -2.5, 1234567.891, 0.0, 0.375, -0.001, None]
    assert evaluate(numbers.to_fixed("v", 2), inputs, "v double") == ["0.13", "1.00", "1.33", "-2.50", "1234567.89", "0.00", "0.38", "-0.00", None]
    assert evaluate(numbers.to_fixed("v", 0), [0.5, 1.5, 2.5], "v double") == ["1", "2", "3"]


def test_bytes_and_durations(evaluate):
    sizes = [0, 512, 1024, 1536, 5 * 2**20, 3 * 2**40]
    assert evaluate(numbers.human_bytes("v"), sizes, "v long") == ["0.0 B", "512.0 B", "1.0 KB", "1.5 KB", "5.0 MB", "3072.0 GB"]
    assert evaluate(numbers.human_bytes_short("v"), [*sizes, None], "v long") == ["0 B", "512 B", "1 KB", "1.5 KB", "5 MB", "3 TB", None]
    assert evaluate(numbers.minutes_text("v"), [90.0, 0.0, None, 3600.0], "v double") == ["2m", None, None, "60m"]
    assert evaluate(numbers.minutes_text("v", 1), [90.0], "v double") == ["1.5 min"]
    assert evaluate(numbers.signed_text("v"), [1.25, -0.5, 0.0], "v double") == ["+1.25", "-0.50", "+0.00"]


def test_cleaners(evaluate):
    inputs = ["king ( s ) of", "x ( or another ) y", "a ( or ) b", "Assur (ki) city", "word (abc) end", "a , b.c", " ( KUR ) land  "]
    assert evaluate(text.clean_translation("v"), inputs) == ["kings of", "x or another y", "a or b", "Assur city", "word end", "a, b. c", "land"]
    light = ["king ( s ) of", "a ( and ) b", "x (lu) y", "keep (abc)"]
    assert evaluate(text.clean_translation("v", "light"), light) == ["kings of", "a and b", "x y", "keep (abc)"]


def test_skeleton(evaluate):
    inputs = ["šar-rum", "LUGAL 3,5 (d)UTU a-a", "KÙ.BABBAR x₂-ba nan", "", None]
    assert evaluate(text.consonant_skeleton("v"), inputs) == ["šrrm", "LUGAL 3,5 T _", "KÙ.BABBAR xb nan", "", ""]
    assert evaluate(text.dual_input("v"), ["šar-rum", ""]) == ["[SKL:šrrm] šar-rum", ""]


def test_settings(evaluate):
    code = 'CONFIG = {"model_name": "a/b", "batch_size": 8}\nnum_epochs=3\nfp16=True\nmodel.from_pretrained("c")'
    found = evaluate(text.extract_settings("v"), [code, 'x.from_pretrained("c/d")'])
    assert found[0] == {"model_name": "a/b", "batch_size": "8", "num_epochs": "3", "fp16": "true", "save_only_model": "false", "clear_hf_cache": "false"}
    assert found[1]["model_name"] == "c/d"


def test_status(evaluate):
    words = ["queued", "COMPLETE", "cancelAcknowledged", "weird", None]
    assert evaluate(status.normalise_status("v"), words) == ["queued", "complete", "cancelled", "error", "error"]
    assert evaluate(status.normalise_status("v", "submission"), ["SubmissionStatus.PENDING", "complete", "x"]) == ["pending", "complete", "error"]
    assert evaluate(status.normalise_status("v", "tracking"), ["complete", "cancelled", "error"]) == ["FINISHED", "KILLED", "FAILED"]
    assert evaluate(status.normalise_status("v", "job"), ["JOB_STATE_RUNNING", "", None]) == ["RUNNING", "UNKNOWN", "UNKNOWN"]
    messages = ['a/b has status "KernelWorkerStatus.RUNNING"', 'a/b has status "complete"', "nothing"]
    assert evaluate(status.status_from_message("v"), messages) == ["running", "complete", "error"]
    assert evaluate(status.is_error_line("v"), ["Some Error", "runtimeerror", "ValueError: x", "--->", "fine"]) == [True, True, True, True, False]


def test_scores(evaluate):
    maps = [{"chrf++": 0.0, "chrf_pp": 4.0}, {"chrf": 0.0}, {"other": 1.0}]
    assert evaluate(scores.first_nonzero("v", scores.CHRF_NAMES), [(m,) for m in maps], "v map<string,double>") == [4.0, 0.0, None]
    pairs = [(4.0, 9.0), (0.0, 9.0), (None, 9.0)]
    assert evaluate(scores.combined_score("a", "b"), pairs, "a double, b double") == [6.0, None, None]
    assert evaluate(scores.combined_score("a", "b", "zero"), pairs, "a double, b double") == [6.0, 0.0, 0.0]
    bands = ["very_low", "below_baseline", "near_baseline", "competitive", "strong", None]
    assert evaluate(scores.bleu_band("v"), [9.9, 10.0, 15.0, 20.0, 25.0, None], "v double") == bands
    assert evaluate(scores.loss_band("v"), [2.1, 1.1, 1.0, 0.4, None], "v double") == ["high", "moderate", "normal", "low", None]
    assert evaluate(scores.metrics_text("v"), [({"a": 0.12345, "b": None},)], "v map<string,double>") == ["a=0.1235"]
