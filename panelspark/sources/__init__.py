"""Table and questionnaire readers, workbook writers."""
