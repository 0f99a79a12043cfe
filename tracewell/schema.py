"""The window features, whose order is a contract, and the raw event's fields."""

from pyspark.sql import types as T

#: Names and order of the window features.
FEATURES = [
    "total_queries", "unique_queries", "unique_query_ratio", "repeated_query_ratio",
    "nxdomain_rate", "servfail_rate", "noerror_rate",
    "txt_rate", "a_rate", "aaaa_rate", "mx_rate", "cname_rate", "ptr_rate", "srv_rate",
    "avg_query_len", "max_query_len", "long_query_rate",
    "avg_entropy", "max_entropy", "high_entropy_rate",
    "avg_label_count", "max_label_count",
    "avg_max_label_len", "max_max_label_len", "long_label_rate",
    "digit_ratio_avg", "hyphen_ratio_avg", "unique_dns_servers",
    "avg_rtt", "max_rtt", "answer_count_avg", "answer_count_max",
    "ttl_avg", "ttl_min", "unique_answer_ips", "low_ttl_rate",
]

#: Every scalar is read as text first and cast by `tracewell.operators.events.normalize`.
RAW = T.StructType([T.StructField(n, T.StringType()) for n in (
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_id", "query", "qclass", "qtype", "qtype_name",
    "rcode", "rcode_name", "rtt", "answers", "TTLs", "AA", "TC", "RD", "RA", "Z", "rejected",
)])
