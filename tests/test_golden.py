"""Golden rows copied by hand from the reference's one recorded API run:
five datasets, two suites, three evaluations, and the statistics the run
reported for them."""

import datetime as dt

from vellum.operators import registry as R


def _ts(s):
    return dt.datetime.fromisoformat(s).replace(tzinfo=None)


DATASETS = [
    ("f1cf5f0b-3931-405b-bf60-fb167b9dbeac", "test_dataset", "Test dataset for API testing", 0, _ts("2025-10-18T14:47:56.030918"), "{}", False),
    ("b7c0515d-93bb-4598-b26a-bc4c3df7ab82", "test_dataset_updated", "Updated test dataset", 0, _ts("2025-10-18T14:34:16.123133"), "{}", False),
    ("71685f7d-5f03-42a2-8bd9-ed8117a28a5c", "mydataset", "just a test", 0, _ts("2025-10-13T15:58:10.498378"), "{}", False),
    ("77a1ae23-0ed2-4a32-a6f9-083908313106", "abcd", "abcdefg", 25, _ts("2025-10-12T10:55:42.842819"), "{}", False),
    ("596d019a-758b-424c-9143-db666ba52909", "test", "test datasets", 25, _ts("2025-10-11T09:58:09.929637"), '{"company": "company_A"}', False),
]
DS_SCHEMA = "id string, name string, description string, total_rows bigint, created_at timestamp_ntz, dataset_metadata string, is_deleted boolean"

SUITES = [
    ("0437e49c-284d-453a-87d3-4df333aeb257", "test_suite", "Test evaluation suite", "596d019a-758b-424c-9143-db666ba52909", 0, "ready", _ts("2025-10-18T14:47:56.180718"), False),
    ("a701c3cf-d3f6-4c79-9a06-5b15b378a8cd", "Test", "testing suites", "596d019a-758b-424c-9143-db666ba52909", 0, "ready", _ts("2025-10-13T15:03:07.817904"), False),
]
SUITE_SCHEMA = "id string, name string, description string, dataset_id string, total_evals int, status string, created_at timestamp_ntz, is_deleted boolean"

EVALS = [
    ("87928c3a-b13c-4a76-95d1-70a0c36d3026", "test_evaluation", "a701c3cf-d3f6-4c79-9a06-5b15b378a8cd", 0, 0, 0, "pending", _ts("2025-10-18T15:11:50.260156"), None, None, False),
    ("df6fa5ea-3b46-49eb-849e-5d8bbe47f205", "test_evaluation_updated", "a701c3cf-d3f6-4c79-9a06-5b15b378a8cd", 0, 0, 0, "running", _ts("2025-10-18T14:47:56.310350"), None, None, False),
    ("b74e5b7b-d964-440c-86c6-e72e90c816ac", "Eval 16-10-2025 21-02-00", "a701c3cf-d3f6-4c79-9a06-5b15b378a8cd", 0, 0, 0, "pending", _ts("2025-10-16T14:13:23.225082"), None, None, False),
]
EVAL_SCHEMA = ("id string, name string, suite_id string, total_requests int, successful_requests int, failed_requests int, "
               "status string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, is_deleted boolean")


def test_dataset_listing_and_stats(spark):
    ds = spark.createDataFrame(DATASETS, DS_SCHEMA)
    page = R.paginate(ds, 1, 10).collect()
    assert [r["name"] for r in page] == [d[1] for d in DATASETS]  # newest first
    assert page[0]["total_count"] == 5 and page[0]["total_pages"] == 1
    assert not page[0]["has_next"] and not page[0]["has_prev"]
    st = R.dataset_stats(ds).first()
    assert (st["total_datasets"], st["total_rows"], st["average_rows_per_dataset"]) == (5, 50, 10.0)


def test_dataset_search_name_test_returns_three(spark):
    ds = spark.createDataFrame(DATASETS, DS_SCHEMA)
    hits = R.search_conjunctive(ds, name="test").collect()
    assert sorted(r["name"] for r in hits) == ["test", "test_dataset", "test_dataset_updated"]


def test_dataset_metadata_equals(spark):
    ds = spark.createDataFrame(DATASETS, DS_SCHEMA)
    hits = R.metadata_equals(ds, "dataset_metadata", "company", "company_A").collect()
    assert [r["name"] for r in hits] == ["test"]


def test_suite_stats(spark):
    st = R.suite_stats(spark.createDataFrame(SUITES, SUITE_SCHEMA)).first().asDict()
    assert st == {"total_suites": 2, "suites_with_dataset": 2, "suites_without_dataset": 0, "total_ready": 2,
                  "total_running": 0, "total_failed": 0, "total_evals": 0, "average_evals_per_suite": 0.0}


def test_eval_stats(spark):
    st = R.eval_stats(spark.createDataFrame(EVALS, EVAL_SCHEMA)).first().asDict()
    assert st["total_evaluations"] == 3
    assert (st["n_pending"], st["n_running"], st["n_completed"], st["n_failed"]) == (2, 1, 0, 0)
    assert (st["total_requests"], st["successful_requests"], st["failed_requests"]) == (0, 0, 0)
    assert st["success_rate"] == 0.0 and st["average_requests_per_eval"] == 0.0
    assert st["average_completion_time_seconds"] is None


def test_to_record_iso_and_lower_status(spark):
    ev = spark.createDataFrame(EVALS, EVAL_SCHEMA)
    rec = {r["id"]: r for r in R.to_record(ev, "eval").collect()}
    r = rec["87928c3a-b13c-4a76-95d1-70a0c36d3026"]
    assert r["created_at"] == "2025-10-18T15:11:50.260156"
    assert r["status"] == "pending" and r["started_at"] is None


def test_suite_detail_shows_dataset_name(spark):
    ds = spark.createDataFrame(DATASETS, DS_SCHEMA)
    su = spark.createDataFrame(SUITES, SUITE_SCHEMA)
    got = {r["id"]: r["dataset_name"] for r in R.suite_with_dataset(su, ds).collect()}
    assert set(got.values()) == {"test"}


def test_frozen_suite(spark):
    su = spark.createDataFrame(SUITES, SUITE_SCHEMA)
    ev = spark.createDataFrame(EVALS, EVAL_SCHEMA)
    got = {r["name"]: (r["n_live_evals"], r["frozen"]) for r in R.suite_frozen(su, ev).collect()}
    assert got == {"Test": (3, True), "test_suite": (0, False)}
