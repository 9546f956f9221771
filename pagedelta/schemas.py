"""Schemas of the tables, as DDL. Absent text is '', absent lists are empty, absent counts are 0; null where named."""

CHANGE_TYPES = (
    "new_page", "content_update", "title_change", "meta_change", "h1_change", "schema_change", "url_case_change", "redirect", "page_removed",
)

DISCOVERED = "domain string, url string, lastmod string, title string, source string, ordinal bigint"
FEED_ENTRY = "domain string, url string, title string, published string, summary string"
PAGE_CAPTURE = "domain string, url string, html string, run int"
PAGE_EXTRACT = (
    "domain string, url string, content_hash string, title string, meta_description string, h1_tags array<string>, "
    "word_count int, canonical string, schemas array<string>, content_snippet string, noindex boolean"
)
PAGE_STATE = (
    "domain string, url string, first_seen timestamp, last_seen timestamp, content_hash string, title string, "
    "meta_description string, content_snippet string, h1_tags array<string>, word_count int, canonical string, "
    "schemas array<string>, lastmod_from_sitemap string, consecutive_missing int"
)
URL_STATUS = "url string, status_code int, redirect_to string, noindex boolean, x_robots string"
SITES = "domain string, name string, total_urls_discovered bigint"
RUNS = "run int, run_ts timestamp"
#: What went wrong in a run and where; a fatal error keeps its site as it was.
ERRORS = "domain string, stage string, url string, error string, fatal boolean"
HOSTS = "netloc string, body string, asked_at timestamp"
#: One struct for the details of every change type; members that a type lacks are null.
DETAILS = (
    "struct<source:string,published_date:string,summary:string,h1:string,schemas:array<string>,word_count:int,old_hash:string,"
    "new_hash:string,diff_summary:string,added:array<string>,removed:array<string>,word_count_change:int,old_word_count:int,"
    "new_word_count:int,old_title:string,new_title:string,old_meta:string,new_meta:string,old_h1:string,new_h1:string,"
    "added_schemas:array<string>,removed_schemas:array<string>,old_url:string,new_url:string,last_seen:timestamp,"
    "first_seen:timestamp,missing_runs:int,noindex:boolean,redirect:struct<status_code:int,redirect_to:string>>"
)
CHANGES = (
    "id string, timestamp timestamp, competitor string, domain string, url string, change_type string, title string, "
    f"details {DETAILS}"
)
