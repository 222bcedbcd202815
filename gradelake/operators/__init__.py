"""DataFrame operators over course documents, questions, answers, reports and sessions."""
