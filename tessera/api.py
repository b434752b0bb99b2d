"""The public names in one place."""

from tessera.functions.picture import calcsize, parse
from tessera.functions.scalars import CONVERTERS, decimal_2, decimal_places, digit_string, digits_5, name_clean, name_cleaner, register_converter
from tessera.operators.flow import (
    audit_counts, by_sheet, control_total, error_counts, header_detail, is_valid, key_frequency, outcomes, process, profile, profile_report, schema_errors,
    switch_case, switch_overlap, validated,
)
from tessera.operators.synth import assemble
from tessera.plans.copybook import json_schema, parse_copybook, reference_format
from tessera.plans.layout import Layout, compile_schema
from tessera.plans.validate import check_schema, schema_problems
from tessera.sources.files import (
    file_suffix, list_sheets, read_any, read_csv, read_ebcdic, read_fixed_text, read_native, read_ndjson, read_ods, read_tab, read_xlsx,
)
from tessera.sources.framing import read_records, with_rdw, write_records
from tessera.sources.loaders import (
    bind, body, expects, read_copybook, schema_from_copybook, schema_from_heading, schema_from_metadata, schemas_from_copybook,
)
from tessera.streaming.records import stream_records

__all__ = [n for n in dir() if not n.startswith("_")]
