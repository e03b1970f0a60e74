"""Operations of a training-data pipeline; nothing else in postlake imports them."""
