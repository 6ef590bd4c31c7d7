from touchline.operators.asof import asof_backward, asof_forward, bucket_of

__all__ = ["asof_backward", "asof_forward", "bucket_of"]
