"""Operations for training-data pipelines on Spark tables of documents, conversations and pages."""
