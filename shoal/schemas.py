"""Column lists (DDL) of the tables the operators expect."""

from __future__ import annotations

_FILE = "filename: string, file_path: string, file_size: bigint, file_type: string, file_hash: string, content_type: string"

CATALOG_DATASET = f"""
    dataset_id string, user_id string, name string, description string, version string, file_type string,
    file_size bigint, file_path string, original_filename string, files array<struct<{_FILE}>>, is_folder boolean,
    columns array<string>, row_count bigint, data_types map<string, string>, tags array<string>,
    custom_metadata struct<split: struct<train: bigint, test: bigint, drift: bigint>, is_mitigated: boolean, file_count: int>,
    is_public boolean, public_source string, public_link struct<dataset_id: string, version: string>,
    created_at timestamp, updated_at timestamp, file_hash string"""

CATALOG_MODEL = f"""
    model_id string, user_id string, name string, description string, version string, framework string,
    model_type string, algorithm string, model_files array<struct<{_FILE}, is_primary: boolean, description: string>>,
    input_shape array<int>, output_shape array<int>, num_parameters bigint, model_size_mb double,
    training_dataset string, training_accuracy double, validation_accuracy double, test_accuracy double,
    training_loss double, leaderboard string, tags array<string>, created_at timestamp, updated_at timestamp,
    is_active boolean, is_production_ready boolean"""

_TIMES = "created_at timestamp, updated_at timestamp"
REPORT_BIAS = ("user_id string, dataset_id string, dataset_version string, report string, "
               f"transformation_report_id string, {_TIMES}")
REPORT_TRANSFORMATION = f"user_id string, dataset_id string, version string, report string, {_TIMES}"
REPORT_DRIFT = ("user_id string, dataset_id string, dataset_version string, model_id string, model_version string, "
                f"report string, {_TIMES}")
REPORT_XAI = ("user_id string, dataset_id string, dataset_version string, model_id string, model_version string, "
              f"report_type string, level string, file_path string, file_size bigint, file_hash string, {_TIMES}")

# Key of each table: rows are unique under it.
KEYS = {
    "catalog_dataset": ("user_id", "dataset_id", "version"),
    "catalog_model": ("user_id", "model_id", "version"),
    "report_bias": ("user_id", "dataset_id", "dataset_version"),
    "report_transformation": ("user_id", "dataset_id", "version"),
    "report_drift": ("user_id", "dataset_id", "dataset_version", "model_id", "model_version"),
    "report_xai": ("user_id", "dataset_id", "dataset_version", "model_id", "model_version", "report_type", "level"),
}

USER_FILE = ("file_id string, user_id string, name string, description string, project_id string, file_path string, "
             "original_filename string, content_type string, size_bytes bigint, created_at timestamp")

FORUM = {
    "theme": "theme_id bigint, name string, description string, views bigint, expert_id bigint, problem_category string, "
             "model_category string, domain_category string, created_at timestamp",
    "document": "document_id bigint, title string, description string, file_path string, file_size bigint, "
                "content_type string, expert_id bigint, theme_id bigint, created_at timestamp",
    "question": "question_id bigint, title string, body string, created_at timestamp, views bigint, expert_id bigint, "
                "theme_id bigint",
    "answer": "answer_id bigint, description string, created_at timestamp, question_id bigint, expert_id bigint, "
              "parent_id bigint",
    "vote": f"vote_id bigint, expert_id bigint, answer_id bigint, vote_value int, {_TIMES}",
    "expert": "expert_id bigint, user_id bigint, is_deleted boolean, area_of_expertise string, bio string, "
              "date_joined timestamp, profile_picture string",
}

LEASE_EVENT = "job_key string, seq bigint, ts timestamp, op string, task_id string"
JOB_PROGRESS = ("job_id string, status string, phase string, processed_files bigint, total_files bigint, "
                "result_version string, updated_at timestamp")
