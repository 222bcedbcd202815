"""Course-assessment analytics on Spark: chunking, retrieval, grading, reports and sessions."""
