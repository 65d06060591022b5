"""Operations of a training-data pipeline, written as DataFrame operators."""
