"""Extensions for streams; the photo dataflows themselves are batch programs."""
