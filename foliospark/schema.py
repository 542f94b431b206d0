"""Explicit schemas, as DDL; nothing is inferred."""

OPTIONS = "struct<model_version:string,is_ocr:boolean,language:string,enable_table:boolean,enable_formula:boolean,extra_formats:array<string>,office_page_ranges:string>"

JOBS = (
    "job_id string, source_path string, source_name string, source_size bigint, source_sha256 string, source_type string, page_count int, "
    f"output_dir string, work_dir string, options {OPTIONS}, state string, created_at timestamp, updated_at timestamp, completed_at timestamp"
)
PARTS = (
    "job_id string, part_index int, local_path string, upload_name string, data_id string, page_start int, page_end int, page_ranges string, "
    "physical boolean, batch_id string, state string, progress string, full_zip_url string, error_code string, error_message string, "
    "trace_id string, full_md string, extracted_dir string"
)
STATUS_ROWS = ("batch_id string, ord bigint, data_id string, file_name string, state string, extract_progress string, full_zip_url string, err_msg string, err_code string, trace_id string")
ZIP_MEMBERS = ("archive string, name string, external_attr bigint, content binary")
IMAGE_SEMANTICS = ("file string, type string, summary string, elements array<string>, key_findings array<string>, keywords array<string>, error string")
TEXT_SEMANTICS = ("sections array<struct<title:string,summary:string>>, entities array<struct<name:string,type:string,description:string>>, cross_references array<string>, tags array<string>")

#: States of parts and jobs that have a meaning here; any other string is kept as it is.
PART_STATES = ("planned", "uploading", "waiting-file", "running", "converting", "failed", "done")
TERMINAL_STATES = ("done", "failed")
