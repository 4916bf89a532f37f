"""Declared schemas of the source tables.

Each table is one text of `name type` entries, in column order: `!` marks NOT NULL, `=value` a
default for a missing value, `type(n)` the longest text allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# The tables as the sources deliver them.
TABLE_TEXT = {
    "users": """
        id text(36)!, login text!, phone_number text!, phone_number_confirmed boolean!=false,
        email_confirmed boolean!=false, role text(50)!, locale text(10)!, questionnaire_id bigint!,
        created timestamp!, disabled timestamp, is_locked boolean!=false, questionnaire_completion bigint!=0,
        loans_paid int!=0, pin text, failed_login_attempts int!=0, lockout_end timestamp""",
    "questionnaires": """
        id bigint!, user_id text(36)!, email text, name text, patronymic text, surname text, sex text(10),
        birth_date date, hometown text, pin text, id_expires date, job_title text, monthly_income decimal(15,2),
        monthly_expenses decimal(15,2), registration_street text, registration_house_number text,
        registration_apartment_number text, registration_region text, residence_street text,
        residence_house_number text, residence_apartment_number text, residence_region text, created timestamp!,
        id_number text, id_series text, company_name text, additional_income decimal(15,2), business_number text,
        citizenship text(50), marital_status smallint, previous_name text, previous_patronymic text,
        previous_surname text, is_beneficial_owner boolean, is_pep boolean, is_related_to_pep boolean,
        political_position text, political_position_taken date, related_pep_full_name text,
        related_pep_position text""",
    "loans": """
        id text(36)!, user_id text(36)!, requested_conditions_id bigint!, offered_conditions_id bigint,
        credit_product_id bigint!, amount bigint!, term int!, start timestamp!, tag text(50)!, state_id bigint!,
        created timestamp!, number bigint!""",
    "loan_states": """
        id bigint!, loan_id text(36)!, target_date timestamp!, principal decimal(15,4)!, fee decimal(15,4)!,
        interest decimal(15,4)!, overdue_interest decimal(15,4)!, total_calculated_interest decimal(15,4)!,
        created timestamp!, debt decimal(15,4)!, transaction_amount decimal(15,4)!,
        transaction_remainder decimal(15,4)!, transaction_type text(50)!""",
    "loan_conditions": "id bigint!, credit_product_id bigint!, amount bigint!, term int!, created timestamp!",
    "credit_products": """
        id bigint!, description text!, min_amount bigint!, max_amount bigint!, min_term int!, max_term int!,
        service_fee decimal(10,6)!, is_one_time_only boolean!=false, is_active boolean!=false, archived timestamp,
        created timestamp!, is_vip boolean!=false""",
    "credit_intervals": """
        id bigint!, credit_product_id bigint!, order_number int!, days int!, rate decimal(10,6)!,
        is_overdue boolean!=false, created timestamp!""",
    "loan_actions": "id bigint!, loan_id text(36)!, user_id text(36)!, tag text(50)!, created timestamp!",
    "payments": """
        id text(36)!, user_id text(36)!, loan_id text(36)!, amount decimal(15,2)!, is_disbursement boolean!=false,
        is_successful boolean, external_transaction_id text, bank_transaction_id text, bank_response text, rrn text,
        card_mask text, card_name text, created timestamp!, card_id text(36), provider smallint!""",
    "cards": """
        id text(36)!, user_id text(36)!, is_main boolean!=false, is_for_disbursement boolean!=false,
        epoint_card_id text!, is_verified boolean!=false, mask text, name text, expiry_date text(10),
        created timestamp!, deleted timestamp""",
    "akb_scores": """
        id text(36)!, timestamp timestamp!, user_id text(36)!, is_successful boolean!, request_accepted boolean!,
        request_purpose_code int!, request_doc_serie text(20)!, request_document_no text!, request_doc_type text(50)!,
        request_pin_code text!, request_birth_date text(20)!, response_report_id bigint, response_reporting_date text,
        response_borrower_document_no text, response_borrower_name text, response_borrower_fin text,
        response_borrower_date_of_birth text(20), response_borrower_place_of_birth text,
        response_borrower_person_type text(50), response_borrower_file_date text,
        response_borrower_location_city text, response_borrower_registered_address text,
        response_borrower_status text(20), response_borrower_participant_of_patriotic_war smallint,
        response_score_calculated smallint, response_score_point decimal(8,2), response_score_response text(10),
        response_score_exclusion smallint, response_json text, error_response_error text,
        error_response_message text""",
    "akb_history_summary": """
        id text(36)!, timestamp timestamp!, user_id text(36)!, is_successful boolean!, request_purpose_code int!,
        request_accept boolean!, request_document_serial text!, request_document_no text!, request_pin text!,
        request_org_id int!, request_branch_id int!, request_user_id int!, response_report_id bigint,
        response_reporting_date text, response_borrower_document_no text, response_borrower_name text,
        response_borrower_fin text, response_borrower_date_of_birth text(20), response_borrower_place_of_birth text,
        response_borrower_person_type text(50), response_borrower_location_city text,
        response_borrower_registered_address text, response_borrower_status text(20),
        response_borrower_participant_of_patriotic_war smallint, response_guarantees text,
        response_inquiry_history_items text, response_score_calculated decimal(8,2),
        response_score_point decimal(8,2), response_balance decimal(15,2), response_comments text, response_xml text,
        liab_count int!, liab_outstanding_debt_main_sum decimal(15,2)!,
        liab_outstanding_debt_interest_sum decimal(15,2)!, liab_days_main_overdue_max int!,
        liab_days_main_overdue_sum int!, response_borrower_file_date text, response_borrower_file_date_string text""",
    "akb_liabilities": """
        id bigint!, bank_id bigint!, bank_name text!, account_no text!, credit_type int!, org_id_type int!,
        granted_on text!, initial_amount decimal(15,2)!, line_amount decimal(15,2)!, days_interest_overdue int!,
        days_main_sum_overdue int!, contract_due_on text!, interest_rate decimal(8,2)!, last_updated_date text!,
        outstanding_debt_main decimal(15,2)!, outstanding_debt_interest decimal(15,2)!,
        monthly_payment_amount decimal(15,2)!, prolongations int!, credit_status int!, credit_purpose int!,
        currency text(10)!, mkr_id bigint!, collateral_code int!, collateral_market_value decimal(15,2)!,
        collateral_registry_agency text, collateral_registry_no text, collateral_any_info text,
        history_history_items text, user_id text(36)!, credit_status_close_date text, collateral_registry_date text,
        last_payment_date text""",
    "doc_front_all": """
        user_id text!, file_name text!, created timestamp!, loan_id text(36)!, number bigint!, tag text(50)!,
        amount bigint!, term int!, start timestamp!""",
    "doc_front_last_per_user": "user_id text!, file_name text!, created timestamp!",
}

# The sheet each table arrives as, by source file.
SHEETS = {
    "01_users-db": {"User": "users", "Questionnaire": "questionnaires"},
    "02_loans-db": {"Loan": "loans", "LoanState": "loan_states", "LoanConditions": "loan_conditions",
                    "CreditProduct": "credit_products", "CreditInterval": "credit_intervals",
                    "LoanAction": "loan_actions"},
    "03_payments-db": {"Payment": "payments", "Card": "cards"},
    "04_elastic_akb-score": {"akb_score": "akb_scores"},
    "05_elastic_akb-history": {"summary": "akb_history_summary", "liabilities": "akb_liabilities"},
    "06_doc_front_files": {"doc_front_all": "doc_front_all", "doc_front_last_per_user": "doc_front_last_per_user"},
}

# Columns whose source values are read leniently or mapped on the way in.
LENIENT_TIMESTAMPS = {"users": ["disabled", "lockout_end"], "credit_products": ["archived"], "cards": ["deleted"],
                      "akb_scores": ["timestamp"], "akb_history_summary": ["timestamp"]}
LENIENT_DATES = {"questionnaires": ["birth_date", "id_expires", "political_position_taken"]}
LENIENT_NUMBERS = {"questionnaires": ["monthly_income", "monthly_expenses", "additional_income"]}
TRI_STATE = {"questionnaires": ["is_beneficial_owner", "is_pep", "is_related_to_pep"], "payments": ["is_successful"]}
TRUTHY = {"users": ["phone_number_confirmed", "email_confirmed", "is_locked"]}
NULLABLE_INTEGERS = {
    "users": ["questionnaire_id", "questionnaire_completion", "loans_paid", "failed_login_attempts"],
    "questionnaires": ["marital_status"], "loans": ["offered_conditions_id"],
    "akb_scores": ["response_report_id"], "akb_history_summary": ["response_report_id"],
}

_TYPES = {"text": "string", "timestamp": "timestamp_ntz"}
_SIMPLE_TYPES = {
    "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType(),
    "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(),
}
_ENTRY = re.compile(r"(?P<name>\w+) (?P<type>\w+(?:\(\d+,\d+\))?)(?:\((?P<length>\d+)\))?(?P<required>!)?(?:=(?P<default>\w+))?")


@dataclass(frozen=True)
class SourceColumn:
    name: str
    type: str
    required: bool
    default: str | None
    length: int | None


def columns(table: str) -> list[SourceColumn]:
    entries = [_ENTRY.fullmatch(e.strip()) for e in re.split(r",\s+", TABLE_TEXT[table].strip())]
    return [
        SourceColumn(e["name"], _TYPES.get(e["type"], e["type"]), bool(e["required"]), e["default"],
                     int(e["length"]) if e["length"] else None)
        for e in entries
    ]


def _data_type(name: str) -> T.DataType:
    if name.startswith("decimal"):
        precision, scale = re.findall(r"\d+", name)
        return T.DecimalType(int(precision), int(scale))
    return _SIMPLE_TYPES[name]


def struct_type(table: str) -> T.StructType:
    """The table's schema for `spark.read.schema(...)`."""
    return T.StructType([T.StructField(c.name, _data_type(c.type), not c.required) for c in columns(table)])
