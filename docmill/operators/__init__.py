"""DataFrame operators: structure, finalisation, index, retrieval, answers, evaluation."""
