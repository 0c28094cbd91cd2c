"""All registered queries and the SQL they are checked against."""

from tendero.plans.job_queries import JOB_QUERIES
from tendero.plans.oracle_jobs import jobs_sql
from tendero.plans.oracle_sales import sales_sql
from tendero.plans.sales_queries import SALES_QUERIES

QUERIES = {**SALES_QUERIES, **JOB_QUERIES}
SQL = {**sales_sql(), **jobs_sql()}
